import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from octavo.llm import quality_classifier, queries, sharding, warc
from octavo.llm.common import Workspace
from pyspark.sql import functions as F


def check_shards(rows, texts, shards=24):
    total, biggest = sum(len((t or "").encode()) + 8 for t in texts), max((len((t or "").encode()) + 8 for t in texts), default=0)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    group = total / shards / sharding.WHOLE
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    if len(texts) > 1000:
        assert all(abs(sum(r.size for r in by[s]) - total / shards) <= 2 * max(biggest, group) for s in range(shards))


@pytest.mark.parametrize("rows", [50_000, 20])
def test_shards_with_hot_groups(spark, rows):
    rng = random.Random(1)
    texts = [None, "", "x" * 3000] + ["hot text"] * 900 + ["".join(rng.choices("ab c", k=rng.randint(0, 90))) for _ in range(1500)]
    df = spark.createDataFrame([(rng.choice([None, i, i // 2]), t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(5)
    got = sharding.shard(df, rows=rows).collect()
    check_shards(got, texts)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert sum(len(x) > 1 for x in where.values()) <= 1  # only the hot group is divided
    assert sharding.shard(df.where("false")).count() == 0


def test_sharding_query(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_shards(queries.op6_sharding(spark, sf).collect(), texts)


def test_warc_round_trip(spark):
    odd = [None, "", "same", "same", "same", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", warc.BETWEEN.decode("latin-1"), "é\x00\x1f\n" * 50_000, "other"]
    rows = [(i, f"http://x/{i} y\n", t) for i, t in enumerate(odd)] + [(4, "u", "same"), (None, None, "same"), (None, "n", "lonely")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("rid", F.lit(1))
    got = warc.round_trip(df.repartition(3)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    seen = Counter()
    for r in got:
        t = next(t for t in groups if base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() == r.payload_digest)
        last = max((i for i in groups[t] if i is not None), default=None)
        assert r.payload_bytes == len(t.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.record_type == "response" else ("revisit", last))
        assert r.record_type == "revisit" or r.page_id == last
        seen[t, r.record_type] += 1
    assert all(seen[t, "response"] == 1 and seen[t, "revisit"] == len(ids) - 1 for t, ids in groups.items())
    assert warc.round_trip(df.where("false")).count() == 0


def test_archives_are_gzip_members_with_payloads(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "two"), (3, "http://c", "two")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/w", Workspace(spark))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") == 9 and b"WARC-Refers-To" in data
    got = {r.response.payload for r in warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).collect()}
    assert {bytes(x) for x in got if x is not None} == {b"one", b"two"}
    small = warc.round_trip(df, least=4).collect()
    assert all(r.record_type == "response" for r in small)


def test_radix_selection(spark):
    rng = random.Random(3)
    values = [rng.choice([0, -1, 5, 2**63 - 1, -(2**63), rng.randrange(-(2**63), 2**63)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    for k in (1, 7, 200, 400):
        kth = sorted(values, reverse=True)[k - 1]
        assert sorted(r.k for r in quality_classifier.top_k(df, "k", k).where("kept").collect()) == sorted(v for v in values if v >= kth)
    assert quality_classifier.top_k(df, "k", 0).where("kept").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_classifier.resample(docs, quality_classifier.good_labels(labels.where("doc_id % 2 = 0")), columns=["doc_id"])
    held = found.select("row.doc_id", "score", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    auc = sum((g.score > b.score) + 0.5 * (g.score == b.score) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.95
    assert sum(r.kept for r in good) / len(good) > 0.9 and sum(r.kept for r in bad) / len(bad) < 0.25


def test_classifier_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, " "), (3, "c " * 50_000)], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    none = df.select("doc_id").where("false")
    got = quality_classifier.resample(df, none, share=0.4).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2 and all(r.score == 0 for r in got)
    assert quality_classifier.resample(df.where("false"), none).count() == 0
    again = quality_classifier.resample(df, df.select("doc_id").where("doc_id = 1"), share=1.0).collect()
    assert all(r.kept for r in again)


def test_small_groups_stay_whole_in_many_ranges(spark):
    rng = random.Random(4)
    texts = [f"{k:04d}" + "x" * 90 for k in range(455) for _ in range(12)] + ["y" * 2_000_000]
    rng.shuffle(texts)
    for size in (5, 50_000):
        rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), rows=size).collect()
        where = defaultdict(set)
        for r in rows:
            where[r.text_crc32].add(r.shard)
        assert len(rows) == len(texts) and all(len(x) == 1 for x in where.values())
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_parts_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    pages = [(i, "http://x", rng.randbytes(rng.choice([100, 5_000, 60_000])).hex()) for i in range(300)] + [(999, "u", rng.randbytes(400_000).hex())]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write(df, f"file://{tmp_path}/w", Workspace(spark), part=1 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 1 << 20 and len(sizes) < len(pages)
    got = warc.assemble(warc.read(spark, f"file://{tmp_path}/w")).collect()
    assert {(r.metadata.page_id, bytes(r.response.payload).decode()) for r in got} == {(i, t) for i, _, t in pages}


def brute_weights(docs, good):
    """By dictionaries: n-grams are (word,) and pairs; words as the operator cuts them. Buckets are its own."""
    import numpy as np

    n = quality_classifier.BUCKETS
    def grams(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return quality_classifier.Grams().buckets(raw, np.array([0, len(raw)]), n)[0].tolist()
    own = {i: grams(t) for i, t in docs}
    count = lambda ids: Counter(g for i in ids for g in own[i])
    raw, target = count(own), count(good)
    s, mix = quality_classifier.SMOOTHING, quality_classifier.MIX
    a, b = sum(raw.values()) + s * n, sum(target.values()) + s * n
    ratio = lambda g: math.log(mix * ((target[g] + s) / b) / ((raw[g] + s) / a) + 1 - mix)
    return {i: (len(g), sum(map(ratio, g))) for i, g in own.items()}


def test_weights_and_draw_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    good = [i for i, _ in docs][:60]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    chosen = spark.createDataFrame([(i,) for i in good], "doc_id long")
    got = quality_classifier.resample(df, chosen, columns=["doc_id"], length=None).collect()
    want = brute_weights(docs, good)
    assert all(r.n_grams == want[r.row.doc_id][0] and abs(r.log_weight - want[r.row.doc_id][1]) < 1e-6 * (1 + abs(r.log_weight)) and r.score == r.log_weight for r in got)
    kept = sorted((r.gumbel_key for r in got), reverse=True)[: round(quality_classifier.SHARE * len(docs))]
    assert {r.row.doc_id for r in got if r.kept} == {r.row.doc_id for r in got if r.gumbel_key >= kept[-1]}
    noise = [r.gumbel_key - r.score for r in got]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.4


def test_draw_does_not_depend_on_partitions(spark):
    rows = [(i % 50, f"word{i % 7} other") for i in range(400)] + [(None, "same")] * 90
    df, good = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,), (2,)], "doc_id long")
    drawn = lambda d: Counter((r.row.doc_id, r.row.text) for r in quality_classifier.resample(d, good, share=0.5).where("kept").collect())
    first = drawn(df)
    assert sum(first.values()) == 245 and first == drawn(df.repartition(7)) == drawn(df.orderBy("text").coalesce(1))
