import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from octavo.functions import bits
from octavo.operators import checksums, chunks, containers, huffman, latency, lookup, lz77, ogg, sequence
from octavo.plans import catalog
from octavo.sources import pnm, wav
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (float, np.floating)) else str(x) if hasattr(x, "year") else x

    return sorted(str([plain(r[c]) for c in columns]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf)
    want = db.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    theirs = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("chunk", [4096, 20_000, 65_536, 1 << 20])
def test_chunks_do_not_change_checksums(spark, chunk):
    rng = random.Random(chunk)
    data = [(i, rng.randbytes(n)) for i, n in enumerate([0, 1, 1023, 1024, chunk - 1, chunk, chunk + 1, chunk + 1023, chunk + 1024, 70_001])]
    df = spark.createDataFrame(data, "k long, content binary")
    t = chunks.chunks(df, "content", chunk, keep=("k",)).cache()
    assert {r.k: bytes(b"".join(r.b)) for r in t.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "bytes"))), lambda x: x.bytes).alias("b")).collect()} == {k: v for k, v in data}
    t = t.select("k", "chunk_id", F.crc32("bytes").alias("c"), F.octet_length("bytes").cast("long").alias("n"))
    for parts in (1, 4, 7):
        got = {r.k: r.crc for r in checksums.combined_crc(t.repartition(parts), "k", "chunk_id", "c", "n").collect()}
        assert got == {k: zlib.crc32(v) for k, v in data}


def test_checksums(spark):
    data = [b"", b"a", b"123456789", bytes(range(256)) * 30]
    df = spark.createDataFrame(list(enumerate(data)), "k long, content binary")
    got = df.select("k", checksums.adler32(checksums.byte_values(F.col("content"))).alias("a")).collect()
    assert {r.k: r.a for r in got} == {k: zlib.adler32(v) for k, v in enumerate(data)}
    assert checksums.music_crc(b"123456789") == 0xBB3D  # the published check value of this CRC
    assert checksums.ogg_crc(b"123456789") == 0x89A1897F  # as is this


def test_containers_are_read_by_the_standard_library(spark):
    import gzip

    data = [b"", b"x" * 100_000, os.urandom(1000)]
    df = spark.createDataFrame([(d,) for d in data], "content binary")
    got = containers.zlib_stream(containers.gzip(df, "content", 9), "content").collect()
    assert all(gzip.decompress(bytes(r.gzip)) == r.content == zlib.decompress(bytes(r.zlib)) for r in got)


def test_prefix_codes():
    rng = random.Random(1)
    for _ in range(200):
        freqs = [rng.choice([0, 1, 2, 5, rng.randrange(1, 10**6)]) for _ in range(rng.randint(2, 60))]
        for limit in (7, 15):
            n = huffman.code_lengths(freqs, limit)
            used = [f for f in freqs if f]
            assert max(n) <= limit and (len(used) < 2 or sum(2.0**-x for x in n if x) == 1)
            codes = [format(c, f"0{x}b") for c, x in zip(huffman.codes_of(n), n) if x]
            assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    fib = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]
    assert max(huffman.code_lengths(fib, 15)) == 11 and max(huffman.code_lengths(fib, 5)) == 5


@pytest.mark.parametrize("data", [b"", b"a", b"abc" * 1000, bytes(3000), random.Random(1).randbytes(3000), b"the cat and the hat and the bat " * 30])
def test_lz77_steps_replay(data):
    for lazy in (False, True):
        plan, out, at = lz77.steps(data, lazy), bytearray(), 0
        for literals, length, offset in plan:
            out += data[at : at + literals]
            at += literals + length
            for _ in range(length):
                out.append(out[-offset])
            assert length == 0 or 3 <= length <= 258 and 1 <= offset <= 32768
        assert bytes(out) == data


def test_slots():
    assert bits.length_slots()[-2:] == [(27, 227, 5), (28, 258, 0)] and bits.offset_slots()[-1] == (29, 24577, 13)
    assert bits.zigzag()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_as_of_and_locate(spark):
    points = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (2, 3)], "k long, at long")
    steps = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (3, 0, "c")], "k long, pos long, v string")
    assert sorted((r.k, r.at, r.v) for r in lookup.as_of(points, steps, "k", "at", "pos", "v").collect()) == [(1, 0, None), (1, 5, "a"), (1, 9, "b"), (2, 3, None)]
    parts = spark.createDataFrame([(1, 0, 3), (1, 1, 0), (1, 2, 4)], "k long, p long, size long")
    cursors = spark.createDataFrame([(1, 2), (1, 3), (1, 6), (1, 7)], "k long, n long")
    assert sorted((r.n, r.part, r.offset) for r in lookup.locate(cursors, parts, "k", "n", "p", "size").collect()) == [(2, 0, 2), (3, 2, 0), (6, 2, 3)]


def test_squeeze_inverts(spark):
    rng = random.Random(6)
    data = {k: [rng.randint(-300, 300) for _ in range(n)] for k, n in enumerate([1, 2, 3, 8, 9, 50])}
    df = spark.createDataFrame([(k, i, v) for k, x in data.items() for i, v in enumerate(x)], "k long, i long, v long")
    got = {}
    for r in sequence.squeeze(df, ["k"], "i", "v").collect():
        got.setdefault(r.k, {})[r.pos] = r

    def tendency(b, a, n):
        if b >= a >= n:
            x = (4 * b - 3 * n - a + 6) // 12
            x = 2 * (b - a) + 1 if x - (x & 1) > 2 * (b - a) else x
            return 2 * (a - n) if x + (x & 1) > 2 * (a - n) else x
        if b <= a <= n:
            return -tendency(-b, -a, -n)
        return 0

    for k, x in data.items():
        out = []
        for pos in range(len(got[k])):
            r = got[k][pos]
            if r.residual is None:
                out.append(r.avg)
                continue
            left = out[-1] if out else r.avg
            nxt = got[k][pos + 1].avg if pos + 1 in got[k] else r.avg
            diff = r.residual + tendency(left, r.avg, nxt)
            a = r.avg + (abs(diff) // 2 if diff > 0 else -(abs(diff) // 2))
            out += [a, a - diff]
        assert out == x


def test_latency_percentiles_are_upper_edges(spark):
    df = spark.createDataFrame([("s", x) for x in [-5, 0, 100, 199, 200, 10**9]], "k string, late long")
    r = latency.percentiles(df, ["k"], "late", 100).first()
    assert (r.p50, r.p99) == (200, 6400)


def test_wav_files(spark, tmp_path):
    x = np.linspace(-1, 1, 5000).reshape(-1, 2)
    (tmp_path / "a.wav").write_bytes(wav.written(x, 44100) + b"\0")
    (tmp_path / "b.wav").write_bytes(b"RIFF....WAVEjunk")
    got = {os.path.basename(r.path): r for r in wav.read(spark, f"file://{tmp_path}/*.wav").collect()}
    assert (got["a.wav"].channels, got["a.wav"].rate, got["a.wav"].frames) == (2, 44100, 2500) and got["b.wav"].channels is None
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/a.wav")
    back = wav.blocks(files).where("channel = 1").orderBy("block").collect()
    assert [len(r.samples) for r in back] == [1152, 1152, 196] and np.allclose(np.concatenate([r.samples for r in back]), x[:, 1], atol=1e-4)
    eight = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x01\0\x01\0\x40\x1f\0\0\x40\x1f\0\0\x01\0\x08\0data\x03\0\0\0\0\x80\xff"
    assert wav.samples(eight).ravel().tolist() == [-1, 0, 127 / 128]


def test_pnm_files(spark, tmp_path):
    x = np.arange(9 * 10 * 3, dtype=np.uint8).reshape(9, 10, 3)
    (tmp_path / "a.ppm").write_bytes(pnm.written(x).replace(b"P6\n", b"P6 # c\n"))
    t = pnm.read_tiles(spark, f"file://{tmp_path}").collect()
    assert len(t) == 3 * 2 * 2
    first = next(r for r in t if (r.component, r.by, r.bx) == (1, 0, 0))
    assert first["values"] == x[:8, :8, 1].ravel().tolist()
    with pytest.raises(ValueError):
        pnm.parse(b"P5\n4 4\n255\nabc")


def test_ogg_pages():
    packets = [b"", b"x" * 255, b"y" * 700]
    data = ogg.page([ogg.opus_head(2, 312, 48000)], 7, 0, 0) + ogg.page([ogg.opus_tags("v", {"TITLE": "é"})], 7, 1, 0) + ogg.page(packets, 7, 2, 960, True)
    got = ogg.parse(data)
    assert [p[1] for p in got] == [0, 1, 2] and got[2][3] == packets and got[0][3][0][:8] == b"OpusHead"
    with pytest.raises(ValueError):
        ogg.parse(data[:-1] + b"z")
