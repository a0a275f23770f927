import random
import zlib

from octavo.operators import deflate, lz77


def contents(rng):
    text = " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=900)).encode()
    return [b"", b"a", b"abc" * 2000, rng.randbytes(3000), text, bytes(5000), text[:1500] + rng.randbytes(4000) + text[:3000], bytes(range(256)) * 5, rng.randbytes(70000)]


def test_code_lengths_in_runs():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [x for _ in range(rng.randint(1, 12)) for x in [rng.choice([0, 0, 5, 7])] * rng.randint(1, 200)]
        made = []
        for s, extra, _ in deflate.length_items(lengths):
            made += [s] if s < 16 else [made[-1]] * (extra + 3) if s == 16 else [0] * (extra + (3 if s == 17 else 11))
        assert made == lengths


def test_a_block_inflates():
    for x in contents(random.Random(2)):
        kind, bits = deflate.block(x, lz77.steps(x), True)
        bits = deflate.stored_bits(x, 0, True) if kind == "stored" else bits
        assert zlib.decompress(deflate.np.packbits(bits, bitorder="little").tobytes(), -15) == x


def test_spliced_blocks_inflate(spark):
    rows = [(i, x) for i, x in enumerate(contents(random.Random(3)))] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, content binary")
    parts = deflate.parts(df, "id", "content", chunk=1100).cache()
    kinds = {r.kind for r in parts.select("kind").distinct().collect()}
    assert kinds == {"stored", "static", "dynamic"}
    for level in (1, 6):
        got = {r.id: bytes(r.gzip) for r in deflate.gzip(df, "id", "content", 1100, level).collect()}
        assert {i: zlib.decompress(x, 31) for i, x in got.items()} == {i: x for i, x in rows if x is not None}
    sizes = {r.id: r for r in deflate.streams(parts, "id").collect()}
    assert all(len(r.deflate) == -(-r.n_bits // 8) for r in sizes.values())
    assert len(sizes[2].deflate) < 400 and len(sizes[5].deflate) < 150
    # Bytes that don't compress cost their headers and no more.
    assert len(sizes[3].deflate) <= 3000 + 5 * 3


def test_stored_blocks_of_more_than_one_size(spark):
    x = random.Random(4).randbytes(140000)
    df = spark.createDataFrame([(1, x)], "id long, content binary")
    assert zlib.decompress(bytes(deflate.gzip(df, "id", "content", 1 << 20).first().gzip), 31) == x
