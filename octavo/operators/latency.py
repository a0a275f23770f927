"""Deadlines of live frames: lateness, misses, drops, histograms, percentiles, and deltas between polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the histogram (the last takes all beyond), and frames behind from which on frames are dropped.
BINS, BACKLOG = 64, 50


def lateness_bin(late: Column, width: Column | int) -> Column:
    return F.least(F.floor(F.greatest(late, F.lit(0)) / width), F.lit(BINS - 1)).cast("int")


def statistics(frames: DataFrame, keys: list[str], late: str, frame: int) -> DataFrame:
    """keys, frames, misses (late by more than a frame), sum and maximum. Partial sums: no state beyond a row a key."""
    x = F.greatest(F.col(late), F.lit(0))
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if(x > frame).alias("misses"), F.sum(x).alias("total"), F.max(x).alias("worst"))


def percentiles(frames: DataFrame, keys: list[str], late: str, width: int) -> DataFrame:
    """keys, p50, p99: upper edges of the bins that reach half, and 99 of 100."""
    n = frames.groupBy(*keys, lateness_bin(F.col(late), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    edge = lambda share: F.min(F.when(F.col("cum") * 100 >= F.col("all") * share, (F.col("bin") + 1) * width))
    return n.groupBy(*keys).agg(edge(50).alias("p50"), edge(99).alias("p99"))


def dropped(behind: Column) -> Column:
    """Frames skipped by a stream that is so many frames behind: all but the newest, beyond the backlog."""
    return F.when(behind > BACKLOG, behind - 1).otherwise(F.lit(0))


def deltas(polls: DataFrame, keys: list[str], at: str, total: str) -> DataFrame:
    """Adds since: what came since the poll before."""
    return polls.withColumn("since", F.col(total) - F.lag(total, 1, 0).over(Window.partitionBy(*keys).orderBy(at)))
