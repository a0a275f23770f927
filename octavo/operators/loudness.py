"""Loudness by windows: energies of two channels, a histogram of levels, and the level of the loudest 5 %."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds

#: Steps per dB, bins, the share of windows above the level, and the reference level.
STEPS, BINS, LOUDEST, REFERENCE, NOTHING = 100, 12_000, 0.05, 64.82, -24601.0

# The loudness filters by sampling rate. The first: b10, b9, ..., b0, then a10, a9, ..., a1; the second: b2, a2, b1, a1, b0.
YULE = {
    48000: (
        0.00288463683916, 0.00012025322027, 0.00306428023191, 0.00594298065125, -0.02074045215285, 0.02161526843274, -0.01655260341619,
        -0.00009291677959, -0.00123395316851, -0.02160367184185, 0.03857599435200, 0.13919314567432, -0.86984376593551, 2.75465861874613,
        -5.87257861775999, 9.48293806319790, -12.28759895145294, 13.05504219327545, -11.34170355132042, 7.81501653005538, -3.84664617118067,
    ),
    44100: (
        -0.00187763777362, 0.00674613682247, -0.00240879051584, 0.01624864962975, -0.02596338512915, 0.02245293253339, -0.00834990904936,
        -0.00851165645469, -0.00848709379851, -0.02911007808948, 0.05418656406430, 0.13149317958808, -0.75104302451432, 2.19611684890774,
        -4.39470996079559, 6.85401540936998, -8.81498681370155, 9.47693607801280, -8.54751527471874, 6.36317777566148, -3.47845948550071,
    ),
}
BUTTER = {
    48000: (0.98621192462708, 0.97261396931306, -1.97242384925416, -1.97223372919527, 0.98621192462708),
    44100: (0.98500175787242, 0.97022847566350, -1.97000351574484, -1.96977855582618, 0.98500175787242),
}


def weighted(df: DataFrame, key: str, order: str, value: str, rate: int = 44100) -> DataFrame:
    """key, order, y: samples as the ear weighs them, by both filters in turn. A rate without filters raises KeyError."""
    yule, butter = YULE[rate], BUTTER[rate]
    return folds.iir(df, key, order, value, [(list(yule[10::-1]), list(yule[:10:-1])), (list(butter[4::-2]), list(butter[3::-2]))])


def sample_window(rate: int) -> int:
    """Samples of 50 ms, rounded up."""
    return (rate + 19) // 20


def energies(df: DataFrame, keys: list[str], i: str, v: str, window: int) -> DataFrame:
    """keys, k, energy of each whole window; an incomplete last one is dropped."""
    t = df.groupBy(*keys, F.floor(F.col(i) / window).alias("k")).agg(F.sum(F.col(v) * F.col(v)).alias("energy"), F.count(F.lit(1)).alias("_n"))
    return t.where(F.col("_n") == window).drop("_n")


def level_bin(left: Column, right: Column, window: int) -> Column:
    level = STEPS * 10 * F.log10((left + right) / window * 0.5 + 1e-37)
    return F.least(F.greatest(F.floor(level), F.lit(0)), F.lit(BINS - 1))


def title_gain(bins: DataFrame, key: str, bin_: str) -> DataFrame:
    """key, gain: from the loudest bin down to the one that reaches the share."""
    n = bins.groupBy(key, bin_).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(key).orderBy(F.desc(bin_))
    n = n.withColumn("cum", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    return n.where(F.col("cum") >= F.ceil(F.round(F.col("all") * LOUDEST, 9))).groupBy(key).agg((REFERENCE - F.max(bin_) / STEPS).alias("gain"))
