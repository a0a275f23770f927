import random

import corpus_pipeline
import numpy as np
from octavo.llm import jaccard, simhash


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_stage_takes_its_candidates_from_the_named_method(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (3, " ".join(words).upper()), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r.doc_id for r in near(spark, df, "").collect()) == [1, 4]
    monkeypatch.setattr(simhash, "similar_links", lambda nodes, n, least: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in near(spark, df, "").collect()) == [1, 2, 4]


def test_embedding_is_below_hamming_and_grids_meet_their_chance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, (2000, simhash.PARTS), np.uint64)
    flips = np.packbits(rng.random((2000, 64 * simhash.PARTS)) < 0.1516, axis=1, bitorder="little").view(np.uint64)  # 0.8
    b = a ^ flips
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)).sum(axis=1) <= np.bitwise_count(a ^ b).sum(axis=1)).all()
    masks = simhash.wide_grids(1000, 0.8)
    met = (simhash.wide_cells(a, masks) == simhash.wide_cells(b, masks)).any(axis=1)
    assert met.mean() > 0.997
    assert len(simhash.wide_grids(10_000_000, 0.8)) > len(masks) and np.bitwise_count(simhash.wide_grids(10_000_000, 0.8)[0]).sum() > np.bitwise_count(masks[0]).sum()


def test_a_cell_yields_links_in_proportion_to_its_members():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 64, (900, simhash.PARTS), np.uint64)
    fp[:600] = fp[0] ^ np.packbits(rng.random((600, 64 * simhash.PARTS)) < 0.06, axis=1, bitorder="little").view(np.uint64)
    i, j = simhash.wide_links(fp)
    assert len(i) <= 2 * len(fp)
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    first = np.bitwise_count(fp[:, None, 0] ^ fp[None, :, 0])
    want = [(a, b) for a, b in np.argwhere((far <= simhash.FAR) & (first <= simhash.FAR_FIRST)).tolist() if a < b]
    assert len(want) > 100_000 and closure(900, zip(i.tolist(), j.tolist(), strict=True)) == closure(900, want)


def test_components_of_sets_against_brute_force():
    rng = random.Random(4)
    sets = []
    for _ in range(30):
        base = rng.sample(range(10_000), rng.randint(1, 60))
        for _ in range(rng.randint(1, 8)):
            base = [x if rng.random() > 0.08 else rng.randrange(10_000) for x in base]
            sets.append(np.unique(np.array(base, np.uint64)))
    rng.shuffle(sets)
    own = [set(x.tolist()) for x in sets]
    pairs = [(a, b) for b in range(len(own)) for a in range(b) if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.8]
    assert pairs and jaccard.components_of(sets, 0.8).tolist() == closure(len(sets), pairs)


def test_a_cell_ties_each_member_to_the_smallest_it_reaches():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 64, (300, simhash.PARTS), np.uint64)
    for n in (4, 200):  # few pairs, and many
        fp[50 : 50 + n] = fp[50] ^ np.packbits(rng.random((n, 64 * simhash.PARTS)) < 0.02, axis=1, bitorder="little").view(np.uint64)
        i, j = simhash.wide_links(fp)
        assert i.tolist() == list(range(51, 50 + n)) and set(j.tolist()) == {50}
