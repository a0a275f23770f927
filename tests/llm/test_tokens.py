import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from octavo.llm import bpe, packing, queries, units
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n  \n", " a  b", "don't  we'll 'S it's", "foo  bar", "foo  bar", "a  b 　 c", "<|endoftext|>", " x<|endoftext|> <|endoftext|>y <|startoftext|>", "<|endof text|>",
    "é é Å ́x", "ΣΑΣ ΟΔΟΣ İstanbul ß", "1234567 12a34", "a" * 3000, "ab" * 40_000, "日本語 テスト 漢字", "🙂👩‍👩‍👧 x", "\x1c\x1d a \x85b\x85 c", "\tab\n\n\ncd \n ef\r\n", "$$$&&& ###%", "x​﻿y", "٣٤ ⅷ ²",
]


def ids_by_slices(encode, texts):
    out = []
    for _, data, offsets in units.slices(pa.array([None if t is None else t.encode() for t in texts], pa.binary())):
        ids, cuts = encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def both(texts):
    want = [[x.ids for x in Tokenizer.from_file(p).encode_batch([t or "" for t in texts], add_special_tokens=False)] for p in (BYTE, WORD)]
    assert ids_by_slices(lambda d, o: bpe.encode_slice(BYTE, d, o), texts) == want[0]
    assert ids_by_slices(packing.codec(WORD).ids, texts) == want[1]


def test_odd_texts():
    both(ODD)


def test_every_low_code_point_in_context():
    both([f"a{chr(c)}b {chr(c)} {chr(c)}x y{chr(c)}\n{chr(c)}{chr(c)}1 .{chr(c)}" for c in range(0x400)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eéS'\n\t .,1$  ́ßthing日"), max_size=40), min_size=1, max_size=4))
def test_generated_texts(texts):
    both(texts)


def test_small_slices_do_not_matter(monkeypatch):
    monkeypatch.setattr(units, "SLICE", 10)
    both(ODD)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(1, ""), (None, "x y")], "doc_id long, text string").withColumn("id", F.lit("clash"))
    tokenizer = Tokenizer.from_file(BYTE)
    got = bpe.encode(df, BYTE, with_ids=True).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "x y" if r.id is None else ODD[r.id] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = {r.id: r.text for r in bpe.decode(bpe.encode(df, BYTE, with_ids=True).withColumnRenamed("id", "doc_id"), BYTE).collect()}
    assert all(texts[i] == (t or "") for i, t in enumerate(ODD))
    assert bpe.encode(df.where("false"), BYTE).count() == 0


def test_lossy_decoding_of_cut_characters(spark):
    ids = Tokenizer.from_file(BYTE).encode("日本🙂").ids
    cut = [ids[:k] for k in range(len(ids))] + [ids[k:] for k in range(len(ids))]
    got = bpe.decode(spark.createDataFrame(list(enumerate(cut)), "doc_id long, ids array<int>"), BYTE).collect()
    assert [r.text for r in sorted(got)] == Tokenizer.from_file(BYTE).decode_batch(cut, skip_special_tokens=False)


def check_packed(rows, texts):
    tokenizer, by = Tokenizer.from_file(WORD), {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for k, pieces in by.items():
        ids = np.array(tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing(spark, sf):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("start", F.lit("clash"))
    rows = packing.pack(df.repartition(3), WORD).withColumnRenamed("id", "doc_id").collect()
    check_packed(rows, dict(enumerate(ODD)))
    assert packing.pack(df.where("false"), WORD).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packed(queries.op3_packing(spark, sf).collect(), texts)


def test_lengths():
    assert packing.lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.lengths(0) == [] and packing.lengths(4096) == [4096]
