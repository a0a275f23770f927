import numpy as np
from octavo.operators import jpeg
from octavo.sources import pnm


def images():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:37, 0:61]
    smooth = np.stack([(x * 4) % 256, (y * 6) % 256, 128 + 100 * np.sin(x / 9)], axis=2)
    return {
        "gray": smooth[:, :, :1], "colour": smooth, "flat": np.full((8, 8, 1), 77), "dot": np.full((1, 1, 3), 200),
        "noise": rng.integers(0, 256, (40, 33, 1)), "noise3": rng.integers(0, 256, (19, 24, 3)),
    }


def test_an_independent_decoder_reads_the_files(spark, tmp_path):
    made = {}
    for name, x in images().items():
        x = x.astype(np.uint8)
        made[name] = x
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(x, 100))
    rows = spark.read.format("image").load(f"file://{tmp_path}/*.jpg").select("image.*").collect()
    assert len(rows) == len(made)
    for r in rows:
        x = made[r.origin.rsplit("/", 1)[1][:-4]]
        got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        got = got[:, :, ::-1] if r.nChannels == 3 else got
        assert got.shape == x.shape
        assert np.abs(got.astype(int) - x).mean() < 1.5


def test_dataframe_of_files(spark):
    rows = [(1, pnm.written(images()["colour"].astype(np.uint8))), (2, None)]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: r for r in jpeg.encoded(df, "id", "content").collect()}
    assert (got[1].width, got[1].height, got[1].components) == (61, 37, 3) and got[2].jpeg is None
    assert bytes(got[1].jpeg) == jpeg.encode(images()["colour"].astype(np.uint8))
    assert spark.createDataFrame([], df.schema).transform(lambda t: jpeg.encoded(t, "id", "content")).count() == 0
    n = jpeg.symbol_histograms(df, "id", "content").where("kind = 0").groupBy("id", "component").sum("n").collect()
    assert sorted(tuple(r) for r in n) == [(1, c, 5 * 8) for c in range(3)]


def test_tokens_give_the_coefficients_back():
    rng = np.random.default_rng(2)
    coefs = np.where(rng.random((50, 64)) < 0.05, rng.integers(-900, 900, (50, 64)), 0)
    got, at, last = np.zeros_like(coefs), 0, 0
    for b, _, place, _, symbol, extra, size in jpeg.tokens(coefs).tolist():
        value = extra if size == 0 or extra >> (size - 1) else extra - (1 << size) + 1
        if place == 0:
            last, at = last + value, 0
            got[b, 0] = last
        elif symbol == jpeg.SKIP_16:
            at += 16
        elif symbol:
            at += (symbol >> 4) + 1
            got[b, at] = value
    assert (got == coefs).all()


def test_no_code_is_all_ones_and_none_exceeds_16_bits():
    rng = np.random.default_rng(3)
    for h in (np.eye(1, 256, 5, dtype=np.int64)[0] * 9, rng.integers(0, 5, 256), 2 ** np.minimum(np.arange(256) // 8, 40)):
        lengths = jpeg.lengths_of(h)
        assert max(lengths) <= 16 and sum(2.0**-n for n in lengths if n) < 1 and all((n > 0) == (c > 0) for n, c in zip(lengths, h, strict=True))


def test_equal_histograms_share_a_slot():
    a, b = np.zeros(256, np.int64), np.zeros(256, np.int64)
    a[:8], b[100:220] = 500, 50
    assert jpeg.clusters([a, b, b, a])[0] == [0, 1, 1, 0]
    assert jpeg.clusters([a, b, a], 1)[0] == [0, 0, 0]
