import random

import numpy as np
import pytest
import xxhash
from octavo.llm import components, simhash
from octavo.llm.common import Workspace
from pyspark.sql import functions as F


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """id -> smallest id reachable, from (id, fp) by comparing all."""
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = np.array([f for _, f in pairs], np.uint64)
    for k, (i, f) in enumerate(pairs):
        for j in np.flatnonzero(np.bitwise_count(fps[:k] ^ np.uint64(f)) <= 4):
            a, b = sorted((find(i), find(pairs[j][0])))
            root[b] = a
    return {i: find(i) for i, _ in pairs}


def check(rows, got):
    pairs = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(pairs)
    assert {(r.id, r.fp % 2**64, r.component_id) for r in got} == {(i, f, want[i]) for i, f in pairs}
    kept = [r.id for r in got if r.kept]
    assert sorted(kept) == sorted(set(want.values()))


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(5, None), (3, ""), (9, " \n\t"), (1, "One"), (2, "one"), (4, "A b C"), (6, "ä Ä"), (7, long), (8, long + " x"), (10, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("row", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    check(rows, got)
    assert got[0].row.fp == "clash"


@pytest.mark.parametrize("hot", [8192, 40, 4])
def test_against_brute_force_on_chains_and_hot_cells(spark, hot):
    rng = random.Random(3)
    fps = {0, 1}
    for _ in range(6):  # chains and dense balls, from sparse centres so that cells crowd
        f = rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)
        for _ in range(60):
            g = f
            for _ in range(rng.randint(0, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
            f = g if rng.random() < 0.3 else f
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    space = Workspace(spark)
    labels = {r.node: r.root for r in components.connected_components(simhash.near_links(nodes, space, hot), space).collect()}
    want = brute_components([(f - (1 << 64) if f >> 63 else f, f) for f in fps])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = {}
    for f in signed:
        classes.setdefault(want[f], set()).add(f)
    found = {}
    for f in signed:
        found.setdefault(labels.get(f, f), set()).add(f)
    assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in found.values()}


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert [r.component_id for r in got] == [1] * 4 and sum(r.kept for r in got) == 1
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_query_against_brute_force(spark, sf):
    from octavo.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    pairs = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(pairs)
    assert got == {(i, f"{f:016x}", want[i]) for i, f in pairs}
