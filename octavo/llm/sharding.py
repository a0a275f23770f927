"""Sharding by sampled splitters, under the law of equal bytes.

Records are ordered by (hash of the text, id), so equal texts are neighbours. A sample in
which a record's chance is its share of the bytes gives splitters at its quantiles; records are
range-partitioned by them, exact sizes of the ranges are summed, and running sums over
ranges and within each range place every record among all bytes. A shard is a stretch of
total / shards bytes. A group of equal texts goes where its middle lies, as a whole,
unless it is over 1 / WHOLE of a shard: such overfull stretches are subdivided record by record.
A splitter hash that the sample holds twice or more splits within its group by id (and by row, where ids repeat); the sums of such
a group are taken over all its ranges before it is placed.

Scale: rows of about 50 bytes, without text, are written once and shuffled twice, into ranges
of about ROWS rows whatever the hot groups. The driver sees the sample (SAMPLE keys a range),
and one row a range and shard: at most MOST ranges.

Defined cases: a text of any length is one record, whose bytes alone count; a null text counts 8 bytes and equals the empty text; null ids come first in
order; repeated rows are rows of one group; an empty table gives an empty result; clashing columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, name, text_of

SHARDS, WHOLE = 24, 16
#: Rows meant for a range, sampled keys for each range, and the most ranges.
ROWS, SAMPLE, MOST = 50_000, 16, 16_384
EXTRA = 8


def _least(column: str):
    """An order key: null first."""
    return F.coalesce(F.col(column), F.lit(-(2**63)))


def shard(df: DataFrame, shards: int = SHARDS, text: str = "text", id: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark, space = df.sparkSession, Workspace(df.sparkSession)
    t = df.select(name(id).cast("long").alias("id"), text_of(text).alias("text"))
    t = t.select("id", (F.octet_length("text") + EXTRA).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("rid"))
    t = space.write(t, "keys")
    total, n = t.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST, max(2 * shards, math.ceil(n / rows)))
    cuts = _splitters(t, total, ranges)

    def place(batches):
        keys, within = cuts
        for batch in batches:
            key, own, rid = (batch.column(c).to_numpy() for c in ("key", "order", "rid"))
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = np.where(high - low == 1, high, low)  # a hash cut once: the whole group lies after the cut
            for k in np.flatnonzero(high - low > 1):
                at[k] = bisect_right(within, (own[k], rid[k]), low[k], high[k])
            yield batch.drop_columns(["order"]).append_column("range", pa.array(at.astype(np.int32)))

    kinds = "id long, size long, text_crc32 long, key long, rid long"
    placed = t.withColumn("order", _least("id")).mapInArrow(place, f"{kinds}, range int") if n else t.withColumn("range", F.lit(0))
    order = Window.partitionBy("range").orderBy("key", _least("id"), "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("bytes", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("rows", F.count(F.lit(1)).over(order))
    group = Window.partitionBy("range", "key")
    placed = placed.withColumn("group_from", F.min("bytes").over(group)).withColumn("group_to", F.max(F.col("bytes") + F.col("size")).over(group))
    placed = space.write(placed.select(*[c.split()[0] for c in kinds.split(", ")], "range", "bytes", "rows", "group_from", "group_to"), "placed")

    sums = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).orderBy("range").toPandas()  # at most MOST + 1 rows
    before = pd.DataFrame({"r": sums["range"].astype("int32"), "b0": (sums.b.cumsum() - sums.b).astype("int64"), "r0": (sums.c.cumsum() - sums.c).astype("int64")})
    before = spark.createDataFrame(before, "r int, b0 long, r0 long")
    t = placed.join(F.broadcast(before), F.col("range") == F.col("r"))
    t = t.withColumn("group_from", F.col("b0") + F.col("group_from")).withColumn("group_to", F.col("b0") + F.col("group_to"))
    hot = sorted({int(a) for a, b in zip(cuts[0], cuts[0][1:], strict=False) if a == b})  # groups that lie in several ranges: fewer than there are cuts
    if hot:
        own = F.broadcast(spark.createDataFrame([(k,) for k in hot], "k long"))
        whole = t.join(own, F.col("key") == F.col("k"), "left_semi").groupBy("key").agg(F.min("group_from").alias("f"), F.max("group_to").alias("g"))
        t = t.join(F.broadcast(whole.withColumnRenamed("key", "k")), F.col("key") == F.col("k"), "left")
        t = t.withColumn("group_from", F.coalesce("f", "group_from")).withColumn("group_to", F.coalesce("g", "group_to"))
    split = (F.col("group_to") - F.col("group_from")) > F.lit(total // (shards * WHOLE))
    middle = F.when(split, 2 * (F.col("b0") + F.col("bytes")) + F.col("size")).otherwise(F.col("group_from") + F.col("group_to"))
    wide = "decimal(38,0)"
    t = t.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast(wide) * shards / F.lit(2 * max(1, total)).cast(wide))).cast("int")).withColumn("rank", F.col("rows") + F.col("r0"))
    first = t.groupBy("shard").agg(F.min("rank").alias("first")).withColumnRenamed("shard", "s").collect()  # a row a shard
    first = F.broadcast(spark.createDataFrame(first or [], "s int, first long"))
    t = t.join(first, F.col("shard") == F.col("s"))
    return t.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _splitters(t: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Sorted keys and (order, rid) of at most ranges - 1 cuts, from a sample of about SAMPLE keys a range: a record is drawn by its row's own hash, with its share of the bytes."""
    chance = F.col("size") / max(1.0, total / (ranges * SAMPLE))
    drawn = (F.pmod(F.xxhash64("rid", "id", "key"), F.lit(1 << 30)) / (1 << 30)) < chance
    got = t.where(drawn).select("key", _least("id").alias("order"), "rid").toPandas().sort_values(["key", "order", "rid"])
    at = np.unique((np.arange(1, ranges) * len(got)) // ranges)
    got = got.iloc[at[at < len(got)]].drop_duplicates()
    return got["key"].to_numpy(np.int64), list(zip(got["order"].tolist(), got["rid"].tolist(), strict=True))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, text: str = "text", id: str = "doc_id") -> None:
    """Writes the input's rows as Parquet below shard=0, shard=1, ... Ids must be unique."""
    of = shard(df, shards, text, id).select(F.col("id").alias("_id"), "shard")
    df.join(of, name(id).eqNullSafe(F.col("_id"))).drop("_id").write.partitionBy("shard").parquet(path)
