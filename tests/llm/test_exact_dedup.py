import hashlib
import re

from octavo.llm import exact_dedup
from pyspark.sql import functions as F


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_edge_cases_and_small_digits(spark):
    long = "lorem ipsum " * 20_000
    texts = [None, "", " ", "\t\n ", "a", "a", "ab", "a b", "a\t b", long, long + "x", long + "y", long, "é" * 300, "é" * 300, "é" * 299 + "e"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a"), (None, "a"), (None, "only null id"), (None, "only null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(0)).withColumn("kept", F.lit("clash"))
    got = exact_dedup.exact_duplicates(df, first_digit=2, growth=4).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[norm(r.row.text)]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(norm(r.row.text).encode()).hexdigest()
        assert not r.kept or r.row.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.deduplicate(df).columns == df.columns
    assert exact_dedup.deduplicate(df.where("false")).count() == 0
