"""Scalar rules of encoders: divisors, rate tables, hearing, approximations, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilobits a second by table index, from 1.
BITRATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
#: Slope and range of kHz of each hearing curve by type (4 and 5 take the slope as a parameter).
CURVES = {0: (9.0, 0.1, 24.0), 1: (-1.0, 0.1, 24.0), 2: (0.0, 0.1, 24.0), 3: (1.0, 0.1, 24.0), 4: (None, 0.1, 24.0), 5: (None, 3.41, 16.1)}
#: Steps that suffice for the divisor of two longs (Fibonacci numbers take the most).
STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor, not negative."""
    pair = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda p, _: F.when(p.b == 0, p).otherwise(F.struct(p.b.alias("a"), F.when(p.b != 0, p.a % p.b).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), pair, step, lambda p: p.a)


def nearest_bitrate(x: Column) -> Column:
    """The table's nearest rate, the lower of two as near."""
    return F.array_min(F.array(*[F.struct(F.abs(x - r).alias("far"), F.lit(r).alias("rate")) for r in BITRATES])).rate


def bitrate_index(x: Column) -> Column:
    """The rate's place in the table, -1 if it has none."""
    place = F.array_position(F.array(*map(F.lit, BITRATES)), x.cast("int"))
    return F.when(place > 0, place).otherwise(-1).cast("int")


def hearing_threshold(hertz: Column, kind: int, slope: float = 4.0) -> Column:
    """Decibels by frequency."""
    own, low, high = CURVES[kind]
    f = F.least(F.greatest(hertz / 1000.0, F.lit(low)), F.lit(high))
    level = 3.64 * F.pow(f, F.lit(-0.8)) - 6.8 * F.exp(-0.6 * F.pow(f - 3.4, F.lit(2.0))) + 6.0 * F.exp(-0.15 * F.pow(f - 8.7, F.lit(2.0))) + (0.6 + 0.04 * (slope if own is None else own)) * 0.001 * F.pow(f, F.lit(4.0))
    return level + 6.0 if kind == 3 else level


def spreading(bark: Column) -> Column:
    """Energy that masks a neighbour `bark` away; zero from 60 dB down."""
    x = F.when(bark >= 0, bark * 3.0).otherwise(bark * 1.5)
    dip = F.when(x.between(0.5, 2.5), 8.0 * ((x - 0.5) * (x - 0.5) - 2.0 * (x - 0.5))).otherwise(0.0)
    level = 15.811389 + 7.5 * (x + 0.474) - 17.5 * F.sqrt(1.0 + (x + 0.474) * (x + 0.474))
    return F.when(level <= -60.0, 0.0).otherwise(F.exp((dip + level) * 0.2302585093) / 0.6609193)


def rational_atan2(y: Column, x: Column) -> Column:
    """An approximation of the angle to a few thousandths, 0 near the origin."""
    a, b, c, right = 0.43157974, 0.67848403, 0.08595542, 1.5707963267948966
    ratio = lambda p, q: x * y * (p + a * q) / ((p + b * q) * (p + c * q))
    x2, y2 = x * x, y * y
    turn = lambda v: F.when(v < 0, -right).otherwise(right)
    return F.when(x2 + y2 < 1e-18, 0.0).when(x2 < y2, turn(y) - ratio(y2, x2)).otherwise(ratio(x2, y2) + turn(y) - turn(x * y))


def three_quarters(x: Column) -> Column:
    """The magnitude to the power of 3/4, by two roots."""
    return F.sqrt(F.abs(x) * F.sqrt(F.abs(x)))


def psnr(squares: Column, n: Column, peak: float) -> Column:
    """Decibels of the peak over the mean squared error; null without an error."""
    return F.when(squares > 0, 10.0 * F.log10(peak * peak / (squares / n)))


def fast_log2(x: Column) -> Column:
    """log2 of a positive number as a straight line between neighbouring 512ths of its octave."""
    octave = F.floor(F.log2(x))
    # A logarithm off by an ulp at a power of two is put right.
    octave = octave + F.when(x < F.pow(F.lit(2.0), octave), -1).when(x >= F.pow(F.lit(2.0), octave + 1), 1).otherwise(0)
    place = (x / F.pow(F.lit(2.0), octave) - 1) * 512
    at, part = F.floor(place), place - F.floor(place)
    return octave + (1 - part) * F.log2(1 + at / 512) + part * F.log2(1 + (at + 1) / 512)


def reservoir_budget(level: Column, most: Column, mean: Column, saving: bool = True) -> Column:
    """target and extra bits of a frame. Over nine tenths full, the excess is spent; else a tenth of the mean is saved. At most six tenths come from the store."""
    full = level * 10 > most * 9
    excess = F.when(full, level - F.floor(most * 9 / 10)).otherwise(0)
    target = F.when(full, mean + excess).otherwise(F.floor(mean * 0.9) if saving else mean)
    extra = F.greatest(F.least(level, F.floor(most * 6 / 10)) - excess, F.lit(0))
    return F.struct(target.cast("long").alias("target"), extra.cast("long").alias("extra"))


def takes_mid_side(middle: Column, plain: Column, same_types: Column) -> Column:
    """Whether a frame's two channels go as sum and difference: no dearer by perceptual entropy, and blocks of the same types."""
    return (middle <= plain) & same_types


def most_samples(size: Column, offset: Column, limit: Column, channels: Column, bits: Column) -> Column:
    """Samples a channel that a file can hold after its header, within a limit of bytes; 0 if the size isn't known (null)."""
    data = F.least(F.greatest(size - offset, F.lit(0)), limit)
    width = F.greatest(F.floor((bits + 7) / 8), F.lit(1))
    return F.when(size.isNull(), F.lit(0)).otherwise(F.floor(data / (channels * width)) + 1).cast("long")
