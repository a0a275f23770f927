"""Live-frame latency and encoder statistics over the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import latency
from .registry import query, table

LATE = "e as (select event_type, user_id, event_id, ts, round(value * 1000)::bigint - 20000 as late from events)"


def frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts", (F.round(F.col("value") * 1000).cast("long") - 20000).alias("late"))


@query(f"with {LATE} select event_type, count(*) as frames, count(*) filter (where late > 10000) as misses, sum(greatest(late, 0))::bigint as total, max(greatest(late, 0)) as worst from e group by event_type")
def deadline_statistics(spark, sf_dir):
    return latency.statistics(frames(spark, sf_dir), ["event_type"], "late", 10000)


@query(f"""
    with {LATE}, n as (select event_type, least(greatest(late, 0) // 2000, 63)::int as bin, count(*) as n from e group by all),
    c as (select *, sum(n) over (partition by event_type order by bin) as cum, sum(n) over (partition by event_type) as t from n)
    select event_type, min(case when cum * 100 >= t * 50 then (bin + 1) * 2000 end)::int as p50, min(case when cum * 100 >= t * 99 then (bin + 1) * 2000 end)::int as p99 from c group by event_type""")
def latency_percentiles(spark, sf_dir):
    return latency.percentiles(frames(spark, sf_dir), ["event_type"], "late", 2000)


@query(f"with {LATE} select event_type, least(greatest(late, 0) // 2000, 63)::int as bin, count(*) as n from e group by all")
def lateness_histogram(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("event_type", latency.lateness_bin(F.col("late"), 2000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("with b as (select user_id, count(*) as behind from events group by user_id) select user_id, behind, case when behind > 50 then behind - 1 else 0 end as dropped from b")
def dropped_frames(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("behind"))
    return t.select("user_id", "behind", latency.dropped(F.col("behind")).alias("dropped"))


@query(f"""
    with {LATE}, p as (select event_type, date_trunc('hour', ts) as poll, count(*) filter (where late > 10000) as m from e group by all),
    c as (select event_type, poll, sum(m) over (partition by event_type order by poll)::bigint as misses from p)
    select event_type, poll, misses, misses - lag(misses, 1, 0) over (partition by event_type order by poll) as since from c""")
def polled_misses(spark, sf_dir):
    """Misses up to each poll, and since the one before."""
    p = frames(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("poll")).agg(F.count_if(F.col("late") > 10000).alias("m"))
    p = p.select("event_type", "poll", F.sum("m").over(Window.partitionBy("event_type").orderBy("poll")).alias("misses"))
    return latency.deltas(p, ["event_type"], "poll", "misses")


@query("""
    select coalesce(l_returnflag, '*') as mode, coalesce(l_linestatus, '*') as block, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)""")
def encoder_cube(spark, sf_dir):
    """Counts by mode and block type with totals of both."""
    t = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").count()
    return t.select(F.coalesce("l_returnflag", F.lit("*")).alias("mode"), F.coalesce("l_linestatus", F.lit("*")).alias("block"), F.col("count").alias("n"))


@query("""
    with m as (select l_returnflag as level, l_suppkey as file, median(l_extendedprice) as a, median(l_extendedprice * (1 - l_discount)) as b from lineitem group by all)
    select level, round(sum(a)) as before, round(sum(b)) as after, round(sum(a) / sum(b), 6) as factor from m group by level""")
def benchmark_totals(spark, sf_dir):
    """Sums of the files' medians per level, and their ratio."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("level"), "l_suppkey").agg(F.median("l_extendedprice").alias("a"), F.median(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return t.groupBy("level").agg(F.round(F.sum("a")).alias("before"), F.round(F.sum("b")).alias("after"), F.round(F.sum("a") / F.sum("b"), 6).alias("factor"))


@query("select user_id, time_bucket(interval '5 minutes', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""
    with r as (select *, row_number() over (partition by event_type order by event_id desc) as k from events)
    select event_type, count(*) as n, min(event_id) as oldest from r where k <= 512 group by event_type""")
def recent_history(spark, sf_dir):
    """The newest 512 frames of each stream."""
    t = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id"))))
    return t.where("k <= 512").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest"))


@query("""
    with a as (select user_id, event_id // 100 as block, count(*) as n from events group by all), b as (select user_id, event_id // 100 as block, max(event_id) as m from events where event_type = 'click' group by all)
    select a.block, sum(a.n)::bigint as n, min(b.m) as released from a join b using (user_id, block) group by a.block""")
def released_blocks(spark, sf_dir):
    """Blocks that both consumers have done, and the least progress among them."""
    e = table(spark, sf_dir, "events").withColumn("block", F.floor(F.col("event_id") / 100))
    a = e.groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n"))
    b = e.where("event_type = 'click'").groupBy("user_id", "block").agg(F.max("event_id").alias("m"))
    return a.join(b, ["user_id", "block"]).groupBy("block").agg(F.sum("n").alias("n"), F.min("m").alias("released"))
