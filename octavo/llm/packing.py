"""Packing by power-of-two decomposition.

A document's ids (with the end id) are split into pieces of 4096 and the binary digits of
the rest, largest first. Each piece is a sequence of its own: no sequence crosses
documents, and as every length is a power of two, none is padded. Equal lengths form a
bucket, from which batches are drawn.

sequence_id: the bucket (log2 of the length) in the top bits, then the task and the count
within task and bucket: unique without a second pass, and sorted by it, buckets are contiguous.

Scale: one narrow pass over the documents, no shuffle; a worker holds a slice of
`units.SLICE` bytes and at most one longer document at a time.

Defined cases: a null or blank text is the end id alone; repeated rows and ids are packed
row by row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import units
from .common import Workspace, name

LONGEST, END = 4096, 2
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_codecs: dict[str, units.Codec] = {}


def codec(path: str) -> units.Codec:
    """One a worker and vocabulary: what it has learned serves all its tasks."""
    if path not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _codecs[path] = units.Codec(lambda new: [x.ids for x in tokenizer.encode_batch([u.decode() for u in new], add_special_tokens=False)], attach=False, fold=True)
    return _codecs[path]


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of n ids: a sum of powers of two."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(df: DataFrame, path: str, text: str = "text", id: str = "doc_id", longest: int = LONGEST, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id column, then SCHEMA; with_ids adds the piece's ids."""
    Workspace(df.sparkSession)
    given = df.select(name(id).alias("id"), name(text).cast("binary").alias("data"))

    def run(batches):
        known, counts, task = codec(path), [0] * longest.bit_length(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, data, offsets in units.slices(batch.column("data")):
                ids, cuts = known.ids(data, offsets)
                ids = np.ascontiguousarray(ids, "<u4")
                rows, out, parts = [], [], []
                for k in range(len(offsets) - 1):
                    own = np.append(ids[cuts[k] : cuts[k + 1]], np.uint32(end)).astype("<u4")
                    view, start = memoryview(own).cast("B"), 0
                    for n in lengths(len(own), longest):
                        bucket = n.bit_length() - 1
                        rows.append(at + k)
                        out.append((start, n, zlib.crc32(view[4 * start : 4 * (start + n)]), len(own), bucket << 58 | task | counts[bucket], 0))
                        if with_ids:
                            parts.append(own[start : start + n])
                        counts[bucket] += 1
                        start += n
                columns = [batch.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["id", *(c.split()[0] for c in SCHEMA.split(", ")), *["ids"] * with_ids])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(units.tidy(run), f"id {kind}, {SCHEMA}" + ", ids array<int>" * with_ids)
