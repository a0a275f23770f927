import random
import re

from octavo.llm import license_scan, queries
from pyspark.sql import functions as F

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
ODD = [
    None, "", " \n", "CC BY", "cc-by cc by\tCC_BY 4.0", "(c) 2020 All Rights Reserved. all rights reserved", "GNU General Public License, version 2", "é all ÿ rights reserved", "K all rights reserveds cc byb",
    "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of", "the MIT License", "cc by " * 5000, "word " * 50_000 + "all rights reserved",
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    at = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_detections(text):
    """All places of all rules, keyword or not, then all pairs for containment."""
    w = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))) + " "
    found = []
    for rule, keyword, label, pattern, priority, _ in license_scan.rules():
        if f" {keyword} " in w:
            found += [(priority, m.start(), m.end(), rule, label) for m in re.finditer(pattern, w)]
    rank = lambda d: (d[1], -d[2], d[3])
    out = []
    for d in found:
        if not any(o is not d and o[1] <= d[1] and o[2] >= d[2] and (o[0] > d[0] or (o[0] == d[0] and rank(o) < rank(d))) for o in found):
            out.append((w[: d[1]].count(" ") - 1, w[: d[2]].count(" "), d[3], d[4]))
    return sorted(out)


def check(rows):
    for r in rows:
        text = r.row.text
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text[:80]
        if len(text or "") < 5000:
            want = brute_detections(text)
            assert [(d.first, d.end, d.rule, d.label) for d in r.detections or []] == want, text
            assert r.labels == ",".join(sorted(({x[3] for x in want} | set(r.base_labels.split(","))) - {""}))
        assert 0 <= r.score <= 1


def test_rules():
    assert len(license_scan.rules()) > 300
    assert all(f" {k} " not in "" and re.compile(p) for _, k, _, p, _, _ in license_scan.rules())


def test_odd_and_generated_texts(spark):
    rng = random.Random(5)
    words = "the gnu general public license version 2 0 licensed under apache cc by sa 4 all rights reserved mit bsd 3 clause copyright 2020 terms spdx identifier".split()
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("rid", F.lit("clash")).repartition(4)
    got = license_scan.scan(df).collect()
    assert len(got) == len(texts)
    check(got)
    assert license_scan.scan(df.where("false")).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_license(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
