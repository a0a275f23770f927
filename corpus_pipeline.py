"""A corpus pipeline of five stages: quality rules, exact dedup, near dedup, personal data, packing.

Each stage is one operator of octavo.llm over all that the stage before kept. The first three drop documents, the
fourth masks spans in texts, and the last returns one row per packed piece (its columns are those of op3_packing).

Defined cases: a null text has no words, so the first stage drops it; an empty table gives no pieces; repeated rows are copies, of which one
stays; a text of any length goes through whole; other columns, whatever their names, travel to the fourth stage.

A stage's output is to be written before the next stage is given it: a stage that gets a written table removes the steps that
the stages before it left, for the same thread and `sf_dir`. It removes none if its rows still come from such steps, from no files, or from files that a stage before it read as well.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from octavo.llm import exact_dedup, jaccard, packing, pii, quality_rules
from octavo.llm.common import Workspace, noted, scratch
from octavo.llm.queries import WORD_BPE, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the outlier test rejects go."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, Jaccard similarity of 0.8 or more) the smallest doc_id stays.

    Candidates come by operator 8's method, SimHash and segment-popcount embedding, with 256 bits (`simhash.similar_links`);
    whole shingle sets decide. Four bits of 64, which the contract fixes for op8 alone, would leave most of such copies in.
    """
    return jaccard.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; every document stays."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, none of which crosses documents."""
    return packing.pack(docs, vocabulary(WORD_BPE)).withColumnRenamed("id", "doc_id")


_steps = threading.local()


def _tidy(k: int, stage: Callable) -> Callable:
    """The stage number k, which removes the steps of those before it once it is given a written table."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _steps.__dict__.setdefault(sf_dir, {})
        files = set(docs.inputFiles()) if any(i < k for i in left) else set()
        folders = [space.folder.split("octavo-")[-1] for i in left if i < k for space in left[i][1]]
        if files and not any(files & left[i][0] for i in left if i < k) and not any(f in x for f in folders for x in files):
            for i in [i for i in left if i < k]:
                for space in left.pop(i)[1]:
                    space.remove()
        with noted() as opened:
            found = stage(spark, docs, sf_dir)
        left[k] = files or set(docs.inputFiles()), opened
        return found

    return run_stage


STAGES = [(n, _tidy(k, f)) for k, (n, f) in enumerate([("quality_rules", quality), ("exact_dedup", exact), ("simhash", near), ("pii", private), ("packing", pack)])]

#: Robust covariances, fingerprints and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written; its own steps, and the output before it, go as soon as that is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space, spent = Workspace(spark), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = space.write(stage(spark, docs, sf_dir), name)
        if spent is not None:
            space.drop(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
