"""Signals as arrays: dot products, energies, autocorrelation, transforms, resampling, block quantisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES, INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def energy(x: Column) -> Column:
    return dot(x, x)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


def silent(x: Column, depth: int) -> Column:
    """Digital silence: no value above one step of that bit depth."""
    return peak(x) <= 1.0 / (1 << depth)


def normalised(x: Column, gain: float = 1.0) -> Column:
    """Of length `gain`; zeros stay."""
    return F.transform(x, lambda v: F.when(energy(x) > 0, v.cast("double") * gain / F.sqrt(energy(x))).otherwise(F.lit(0.0)))


def haar(x: Column) -> Column:
    """Sums and differences of neighbours over the root of two, in place."""
    r = 2**-0.5
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(x) / 2).cast("int")), lambda k: F.array((F.element_at(x, 2 * k - 1).cast("double") + F.element_at(x, 2 * k)) * r, (F.element_at(x, 2 * k - 1).cast("double") - F.element_at(x, 2 * k)) * r))
    return F.flatten(pairs)


def downmix(channels: Column, matrix: list[list[float]]) -> Column:
    """Output channels from input channels; each row of the matrix is scaled so that all rows together weigh as many as there are outputs."""
    total = sum(map(sum, matrix)) or 1.0
    rows = [[c * len(matrix) / total for c in row] for row in matrix]
    return F.array(*[F.aggregate(F.zip_with(channels, F.array(*[F.lit(c) for c in row]), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x) for row in rows])


def _series(kind: T.DataType, f):
    """An Arrow-batched function of one array per row."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(np.asarray(v, float)) for v in x], dtype=object)

    return run


def autocorrelation(lags: int):
    return _series(DOUBLES, lambda v: [float(v[k:] @ v[: len(v) - k]) for k in range(min(lags, len(v)))])


def levinson(order: int):
    """Linear-prediction coefficients from a signal's autocorrelation."""

    def solve(v):
        r = np.array([v[k:] @ v[: len(v) - k] for k in range(order + 1)])
        a, e = np.zeros(order), r[0]
        for i in range(order):
            if e <= 0:
                break
            k = -(r[i + 1] + a[:i] @ r[i:0:-1]) / e
            a[:i], a[i] = a[:i] + k * a[:i][::-1], k
            e *= 1 - k * k
        return (-a).tolist()

    return _series(DOUBLES, solve)


power_spectrum = _series(DOUBLES, lambda v: (np.abs(np.fft.rfft(v)) ** 2).tolist())


def hartley(v: np.ndarray) -> np.ndarray:
    f = np.fft.fft(v)
    return f.real - f.imag


hartley_transform = _series(DOUBLES, lambda v: hartley(v).tolist())


def mdct_matrix(n: int) -> np.ndarray:
    """n coefficients of 2n windowed samples."""
    t, k = np.arange(2 * n), np.arange(n)[:, None]
    return np.sin(np.pi / (2 * n) * (t + 0.5)) * np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))


def mdct(n: int):
    m = mdct_matrix(n)
    return _series(T.ArrayType(DOUBLES), lambda v: [(m @ v[i : i + 2 * n]).tolist() for i in range(0, len(v) - 2 * n + 1, n)])


def dct_matrix(n: int = 8) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def block_dct():
    """Of 64 values, row by row."""
    m = dct_matrix()
    return _series(DOUBLES, lambda v: (m @ v[:64].reshape(8, 8) @ m.T).ravel().tolist())


def quantised(coefs: Column, scale: Column, dead: float) -> Column:
    """AC: nearest even if at least `dead` in size, else 0; DC (the first): half away from zero."""
    return F.transform(coefs, lambda c, i: F.when(i == 0, F.round(c * scale)).when(F.abs(c * scale) >= dead, F.rint(c * scale)).otherwise(F.lit(0.0)).cast("int"))


def sinc_table(up: int, down: int, taps: int = 16) -> np.ndarray:
    """A phase a row: a windowed sinc at the lower of both rates."""
    cut = min(1.0, up / down)
    at = np.arange(taps) - taps / 2 + 1 - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * at) * np.cos(np.pi * at / taps).clip(0) ** 2
    return h / h.sum(axis=1, keepdims=True)


def resampled(up: int, down: int, taps: int = 16):
    table = sinc_table(up, down, taps)

    def run(v):
        n = len(v) * up // down
        at = np.arange(n) * down
        padded = np.pad(v, taps)
        first = at // up - taps // 2 + 1 + taps
        return (padded[first[:, None] + np.arange(taps)] * table[at % up]).sum(axis=1).tolist()

    return _series(DOUBLES, run)


def best_pitch(low: int, high: int):
    """The lag of the largest normalised cross-correlation."""

    def run(v):
        best = [(float(v[k:] @ v[: len(v) - k]) / (float(np.sqrt((v[k:] @ v[k:]) * (v[: len(v) - k] @ v[: len(v) - k]))) or 1.0), -k) for k in range(low, min(high, len(v) - 1) + 1)]
        return -max(best)[1] if best else 0

    return _series(T.IntegerType(), run)


def pulses(k: int):
    """Integers of total size k along the vector, placed one by one where they correlate best."""

    def run(v):
        y, a = np.zeros(len(v), int), np.abs(v)
        for _ in range(k):
            score = (a @ y + a) ** 2 / (y @ y + 2 * y + 1)
            y[int(np.argmax(score))] += 1
        return (y * np.where(v < 0, -1, 1)).tolist()

    return _series(INTS, run)


def bark(freq: Column) -> Column:
    """Hertz to Bark."""
    # Zwicker's formula.
    f = F.greatest(freq, F.lit(0.0)) * 0.001
    return 13.0 * F.atan(0.76 * f) + 3.5 * F.atan(f * f / 56.25)


def masking_square_root(x: Column) -> Column:
    """The perceptual mask of a local difference."""
    # Logarithmic offset and multiplier.
    return 0.25 * F.sqrt(x * F.sqrt(F.lit(211.50759899638012 * 1e8)) + 28.0)


def fuzzy_erosion(neighbours: Column) -> Column:
    """A weighted sum of the four least of a 3 x 3 neighbourhood."""
    # The weights.
    s = F.array_sort(neighbours)
    return sum((F.element_at(s, i + 1) * w for i, w in enumerate((0.125, 0.075, 0.06, 0.05))), F.lit(0.0))
