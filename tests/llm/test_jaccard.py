import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from octavo.llm import jaccard


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_kept(rows):
    sets, root = {i: brute_shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in root if root[i] == i}


def test_pipeline_stage_takes_five_words_at_080(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(5000)]
    rows = [(3, None), (4, " "), (5, "A b"), (6, "a  B"), (7, "a b c d e f")]
    for g in range(40):  # copies of falling similarity, and a chain of copies of copies
        text = rng.choices(words, k=rng.randint(60, 300))
        rows.append((len(rows) + 10, " ".join(text)))
        for k in range(4):
            copy = list(text)
            for at in rng.sample(range(len(text)), max(1, len(text) * (k + 1) // 100)):
                copy[at] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
            text = copy if g % 2 else text
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, df, "")
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)
    assert jaccard.deduplicate(df.where("false")).count() == 0
    assert jaccard.deduplicate(df.limit(1).unionByName(df.limit(1))).count() == 1


def test_similarity_is_exact_at_the_threshold():
    a = [f"w{i}" for i in range(22)]  # 18 shingles of 22 words; the last 2 words differ: 16 of 20
    b = a[:20] + ["x", "y"]
    sets = [jaccard.shingles(" ".join(x).encode()) for x in (a, b)]
    both = len(np.intersect1d(*sets))
    assert (both, both / (len(sets[0]) + len(sets[1]) - both) >= 0.8) == (16, True)


def test_shingle_sets_against_brute_force():
    rng = random.Random(8)
    texts = ["", " ", "A", "a b\tC  d e", "x" * 300_000 + " y " + "X" * 300_000, "é É a"] + ["".join(rng.choices("aBc dé\n", k=rng.randint(0, 200))) for _ in range(300)] + ["w" * rng.randint(1, 9) + " v" * 40_000]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found = list(jaccard.sets_of(np.frombuffer(b"".join(raw), np.uint8), offsets))
    hashes = {}
    for t, own in zip(texts, found, strict=True):
        want = brute_shingles(t)
        assert len(own) == len(want) and np.array_equal(own, jaccard.shingles(t.encode()))
        hashes.setdefault(frozenset(want), own.tobytes())
        assert hashes[frozenset(want)] == own.tobytes()
    assert len(set(hashes.values())) == len(hashes)
