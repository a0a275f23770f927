import random
import re
from collections import Counter

import numpy as np
from octavo.llm import quality_rules, queries
from octavo.llm.common import Workspace
from pyspark.sql import functions as F


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    repeated = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def stats(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


ODD = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a a\n\na a\n a a\nb", "é ñ 😀 *** $|", "w " * 30_000, " ".join(f"w{i % 999}" for i in range(30_000)), "l\n" * 20_000]


def test_statistics_of_odd_and_generated_texts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("ab \n#", k=rng.randint(1, 120))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, rng.choice(["en", None]), rng.choice(["s", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df = df.withColumn("pool", F.lit("clash")).withColumn("n_words", F.lit(-1)).unionByName(df.limit(0).withColumn("pool", F.lit("")).withColumn("n_words", F.lit(0)))
    got = quality_rules.judged(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(r.row.text)
        assert stats(r) == want, r.row.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judged(df.where("false")).count() == 0
    assert quality_rules.clean(df).columns == df.columns


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    clean = lambda: " ".join(" ".join(rng.choices(words, k=rng.randint(8, 16))).capitalize() + "." for _ in range(rng.randint(8, 40)))
    junk = [lambda: re.sub(r"(\w+)", r"\1###", clean()), lambda: clean().upper().replace(" ", "!! "), lambda: clean().replace(" ", " | ")]
    rows = [(i, clean(), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), True) for i in range(600)]
    rows += [(600 + i, junk[i % 3](), rng.choice(["en", "de"]), "a", False) for i in range(90)]  # over a quarter of their pools
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, good boolean")
    got = quality_rules.judged(df).collect()
    assert all(r.kept for r in got if r.row.good)
    assert not any(r.kept for r in got if not r.row.good)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_rules(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(stats(r) == base(texts[r.doc_id]) for r in got)


def brute_mcd(x, rng, starts=60):
    """The half with the least determinant of many random starts, each concentrated until it stays."""
    floor, h = np.eye(x.shape[1]) * quality_rules.FLOOR**2, -(-(len(x) + x.shape[1] + 1) // 2)
    best = (np.inf, None)
    for _ in range(starts):
        own = rng.choice(len(x), x.shape[1] + 1, replace=False)
        for _ in range(30):
            m, c = x[own].mean(axis=0), np.cov(x[own].T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(own):
                break
            own = new
        c = np.cov(x[own].T, bias=True) + floor
        best = min(best, (np.linalg.slogdet(c)[1], tuple(d)))
    return best[0], np.array(best[1]) / quality_rules.CONSISTENCY


def test_estimates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pools, rows = {}, []
    for k, n in enumerate([50, 120, 500, 49]):
        mix = rng.normal(size=(6, 6)) * 200
        x = rng.normal(size=(n, 6)) @ mix + rng.normal(size=6) * 500
        x[: n // 3] = rng.normal(size=(n // 3, 6)) * 30 + x.mean(axis=0) + 9000 * (1 - 2 * (k % 2))  # a third far off, together
        pools[f"p{k}"] = np.round(x).astype(int)
        rows += [(f"p{k}", *map(int, r)) for r in pools[f"p{k}"]]
    df = spark.createDataFrame(rows, "pool string, " + ", ".join(f"x{i} long" for i in range(6))).repartition(3)
    space = Workspace(spark)
    got = {r.pool: r for r in quality_rules.estimates(space.write(df, "x"), space).collect()}
    assert set(got) == {"p0", "p1", "p2"}  # the last is too small
    for pool, e in got.items():
        x = pools[pool]
        least, d = brute_mcd(x.astype(float), rng)
        low = np.array([[e[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(6)] for i in range(6)])
        z = np.linalg.solve(low, (x - np.array([e[f"m{i}"] for i in range(6)])).T)
        own = (z**2).sum(axis=0) / e.scale
        assert e.log_det <= least + 1.5  # of six dimensions; whole buckets take a few rows more than half
        bad = np.arange(len(x)) < len(x) // 3
        assert e.cutoff >= quality_rules.LEAST_CUTOFF and ((own > e.cutoff) == (d > e.cutoff)).mean() > 0.97
        assert (own[bad] > e.cutoff).all() and (own[~bad] <= e.cutoff).mean() > 0.97
