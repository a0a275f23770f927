import re

import corpus_pipeline
from octavo.llm import quality_rules
from test_pii import brute as spans_of
from test_quality_rules import base
from test_simhash import brute_components, brute_fingerprint
from test_tokens import check_packed


def test_stages_return_documents_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "pii", "packing"]


def test_run_against_brute_force(spark, sf):
    """The outlier verdicts are the operator's (tested on its own); all else is computed anew."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    verdict = {r.row.doc_id: r.kept for r in quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    left = []
    for r in rows:
        n = base(r.text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert not (failed and verdict[r.doc_id])
        if verdict[r.doc_id]:
            left.append(r)
    first = {}
    for r in sorted(left, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in first.values()]
    root = brute_components(pairs)
    kept = {r.doc_id: r.text for r in first.values() if root[r.doc_id] == r.doc_id}
    texts = {}
    for i, text in kept.items():
        cuts, merged = sorted((int(s[2].split(":")[1]), int(s[2].split(":")[2]), s[3]) for s in spans_of(text)), []
        for a, b, kind in sorted(((s[0], int(s[2].split(":")[2]), s[3]) for s in spans_of(text)), key=lambda s: (s[0], s[1])):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
            else:
                merged.append((a, b, kind))
        out, at = "", 0
        for a, b, kind in merged:
            out, at = out + text[at:a] + f"<{kind}>", b
        texts[i] = out + text[at:]
        assert bool(cuts) == (texts[i] != text)
    check_packed(corpus_pipeline.run(spark, sf).collect(), texts)
