import numpy as np
import pytest
from octavo.functions import codec
from octavo.operators import loudness
from octavo.plans import catalog
from pyspark.sql import functions as F


def test_loudness_filters_against_their_difference_equations(spark):
    rng = np.random.default_rng(1)
    x = {k: rng.normal(0, 1000, n) for k, n in ((1, 300), (2, 1), (3, 40))}
    rows = [(k, i, float(v)) for k, values in x.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    for rate in loudness.YULE:
        yule, butter = loudness.YULE[rate], loudness.BUTTER[rate]
        got = {(r.k, r.i): r.y for r in loudness.weighted(df, "k", "i", "v", rate).collect()}
        for k, values in x.items():
            x0, y = np.concatenate((np.zeros(10), values)), np.zeros(len(values) + 10)
            for n in range(10, len(y)):
                y[n] = x0[n - 10 : n + 1] @ np.array(yule[:11]) - y[n - 10 : n] @ np.array(yule[11:])
            z, y = np.zeros(len(values) + 2), y[8:]
            for n in range(2, len(z)):
                z[n] = butter[4] * y[n] + butter[2] * y[n - 1] + butter[0] * y[n - 2] - butter[3] * z[n - 1] - butter[1] * z[n - 2]
            assert np.allclose([got[k, i] for i in range(len(values))], z[2:], rtol=1e-9, atol=1e-6)
    with pytest.raises(KeyError):
        loudness.weighted(df, "k", "i", "v", 1000)


def test_a_low_tone_is_weighed_less_than_one_of_a_kilohertz(spark):
    t = np.arange(4000) / 44100
    rows = [(k, i, float(v)) for k, hertz in ((1, 30), (2, 3000)) for i, v in enumerate(np.sin(2 * np.pi * hertz * t))]
    got = loudness.weighted(spark.createDataFrame(rows, "k long, i long, v double"), "k", "i", "v").where("i > 1000").groupBy("k").agg({"y": "stddev"}).collect()
    level = {r[0]: r[1] for r in got}
    assert level[1] < level[2] / 10


def test_levels_of_squeezes_halve(spark, sf):
    t = catalog.QUERIES["squeeze_levels"](spark, sf).groupBy("user_id").pivot("level", [0, 1, 2, 3]).count()
    for r in t.collect():
        assert r["2"] == -(-r["1"] // 2) and r["3"] == -(-r["2"] // 2) and r["0"] == r["3"]


def test_an_unknown_size_has_no_limit_of_samples(spark):
    t = spark.createDataFrame([(None,), (0,), (44,), (52,), (10**9,)], "size long")
    got = t.select(codec.most_samples(F.col("size"), F.lit(44), F.lit(1000), F.lit(2), F.lit(16))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 3, 251]
