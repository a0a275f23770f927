"""Files as rows of fixed-size chunks: position is the key of everything downstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A last chunk below this joins the one before.
LEAST_LAST = 1024


def chunk_starts(size: Column, chunk: int, least_last: int = LEAST_LAST) -> Column:
    """0, chunk, 2 chunk, ... such that each later start leaves at least `least_last` bytes."""
    last = F.greatest(F.floor((size - least_last) / chunk), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: k * chunk)


def chunks(df: DataFrame, content: str, chunk: int, least_last: int = LEAST_LAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: keep, chunk_id, start, bytes. A narrow generate: no shuffle."""
    size = F.octet_length(content).cast("long")
    starts = df.select(*keep, F.col(content).alias("_content"), size.alias("_size"), F.posexplode(chunk_starts(size, chunk, least_last)).alias("chunk_id", "start"))
    end = F.when(F.col("start") + chunk + least_last <= F.col("_size"), F.lit(chunk).cast("long")).otherwise(F.col("_size") - F.col("start"))
    return starts.select(*keep, "chunk_id", "start", F.substring(F.col("_content"), (F.col("start") + 1).cast("int"), end.cast("int")).alias("bytes"))
