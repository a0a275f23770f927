"""Ordered-sequence operators: deltas, runs, squeezes, prefix sums, top-k, as expressions and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds delta: value minus the one before, the first minus 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))


def runs(df: DataFrame, keys: list[str], order: str, zero: Column, cap: int) -> DataFrame:
    """keys, start, length: runs of rows for which zero holds, cut at `cap` rows. Gaps and islands: two windows over one sort."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = df.withColumn("_z", zero).withColumn("_i", F.row_number().over(w)).withColumn("_g", F.sum(F.when(F.col("_z"), 0).otherwise(1)).over(w))
    t = t.where("_z").withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("_i")) - 1)
    return t.groupBy(*keys, "_g", F.floor(F.col("_k") / cap).alias("_c")).agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g", "_c")


def average(a: Column, b: Column) -> Column:
    """The mean, rounded towards a, by an arithmetic shift."""
    return F.shiftright(a + b + F.when(a > b, 1).otherwise(0), 1)


def tendency(b: Column, a: Column, n: Column) -> Column:
    """The slope that neighbours b and n predict inside the pair of average a, 0 unless they are monotone."""
    down = F.floor((4 * b - 3 * n - a + 6) / 12)
    up = F.ceil((4 * b - 3 * n - a - 6) / 12)

    def limit(x, sign):
        high, low = 2 * (b - a), 2 * (a - n)
        odd = x.bitwiseAND(F.lit(1))
        x = F.when(sign * (x - sign * odd) > sign * high, high + sign).otherwise(x)
        return F.when(sign * (x + sign * x.bitwiseAND(F.lit(1))) > sign * low, low).otherwise(x)

    return F.when((b >= a) & (a >= n), limit(down.cast("long"), 1)).when((b <= a) & (a <= n), limit(up.cast("long"), -1)).otherwise(F.lit(0))


def squeeze(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, pos, avg, residual (null for an odd last): pairs along `order`, whose positions are 0, 1, ..."""
    t = df.groupBy(*keys, F.floor(F.col(order) / 2).alias("pos")).agg(F.max(F.when(F.col(order) % 2 == 0, F.col(value))).alias("a"), F.max(F.when(F.col(order) % 2 == 1, F.col(value))).alias("b"))
    t = t.withColumn("avg", F.when(F.col("b").isNull(), F.col("a")).otherwise(average(F.col("a"), F.col("b"))))
    w = Window.partitionBy(*keys).orderBy("pos")
    left = F.coalesce(F.lag("b").over(w), F.col("avg"))
    nxt = F.coalesce(F.lead("avg").over(w), F.col("avg"))
    return t.select(*keys, "pos", "avg", (F.col("a") - F.col("b") - tendency(left, F.col("avg"), nxt)).alias("residual"))


def squeezed(df: DataFrame, keys: list[str], order: str, value: str, levels: int) -> DataFrame:
    """keys, level, pos, residual: pairs squeezed, then their averages, `levels` times; the last averages as level 0. Each level has half the rows of the one before."""
    made, t = [], df.select(*keys, F.col(order).alias("pos"), F.col(value).alias("avg"))
    for level in range(1, levels + 1):
        t = squeeze(t, keys, "pos", "avg")
        made.append(t.select(*keys, F.lit(level).alias("level"), "pos", F.coalesce("residual", F.lit(0)).cast("long").alias("residual")))
    made.append(t.select(*keys, F.lit(0).alias("level"), "pos", F.col("avg").cast("long").alias("residual")))
    return reduce(DataFrame.unionByName, made)


def before(value: str, keys: list[str], order: str) -> Column:
    """The exclusive prefix sum."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def top(df: DataFrame, keys: list[str], by: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)


def fir(value: str, taps: list[float], keys: list[str], order: str) -> Column:
    """sum(taps[i] * value i rows before), from the rows there are."""
    w = Window.partitionBy(*keys).orderBy(order)
    total = F.lit(0.0)
    for i, tap in enumerate(taps):
        total = total + F.lit(tap) * (F.coalesce(F.lag(value, i).over(w), F.lit(0.0)) if i else F.col(value))
    return total
