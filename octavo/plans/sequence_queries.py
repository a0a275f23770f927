"""Windows over positions: events and line items stand in for samples and coefficients."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, sequence
from .registry import query, table


def samples(spark, sf_dir):
    """Integer samples of each user: the events' values in hundredths, in time order from 0."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return e.withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))


SAMPLES = "s as (select user_id, event_id, round(value * 100)::bigint as v, (row_number() over (partition by user_id order by event_id) - 1)::bigint as i from events)"


@query(f"with {SAMPLES} select user_id, i, v - lag(v, 1, 0) over (partition by user_id order by i) as delta from s")
def dc_delta(spark, sf_dir):
    return sequence.delta(samples(spark, sf_dir), ["user_id"], "i", "v").select("user_id", "i", "delta")


@query(f"""
    with {SAMPLES}, g as (select *, sum(case when v % 3 <> 0 then 0 else 1 end) over (partition by user_id order by i) as g from s),
    k as (select *, (row_number() over (partition by user_id, g order by i) - 1) // 4 as c from g where v % 3 <> 0)
    select user_id, min(i) as start, count(*) as length from k group by user_id, g, c""")
def zero_runs(spark, sf_dir):
    """Runs of samples not divisible by three, cut at four."""
    return sequence.runs(samples(spark, sf_dir), ["user_id"], "i", F.col("v") % 3 != 0, 4)


SQUEEZE = """
    p as (select user_id, i // 2 as pos, max(case when i % 2 = 0 then v end) as a, max(case when i % 2 = 1 then v end) as b from s group by all),
    m as (select *, case when b is null then a else (a + b + case when a > b then 1 else 0 end) >> 1 end as avg from p),
    n as (select *, coalesce(lag(b) over w, avg) as l, coalesce(lead(avg) over w, avg) as n from m window w as (partition by user_id order by pos)),
    t1 as (select *, case when l >= avg and avg >= n then 1 when l <= avg and avg <= n then -1 else 0 end as sg,
                  case when l >= avg and avg >= n then floor((4 * l - 3 * n - avg + 6) / 12)::bigint else ceil((4 * l - 3 * n - avg - 6) / 12)::bigint end as x from n),
    t2 as (select *, case when sg * (x - sg * (x & 1)) > sg * 2 * (l - avg) then 2 * (l - avg) + sg else x end as y from t1),
    t3 as (select *, case when sg * (y + sg * (y & 1)) > sg * 2 * (avg - n) then 2 * (avg - n) else y end as z from t2)"""


@query(f"with {SAMPLES}, {SQUEEZE} select user_id, pos, avg, coalesce(a - b - case when sg = 0 then 0 else z end, 0) as residual from t3")
def squeeze_pairs(spark, sf_dir):
    """Averages and residuals of neighbours, with the neighbours' tendency taken off."""
    return sequence.squeeze(samples(spark, sf_dir), ["user_id"], "i", "v").select("user_id", "pos", "avg", F.coalesce("residual", F.lit(0)).cast("long").alias("residual"))


LEVEL = f"select user_id, pos, avg, coalesce(a - b - case when sg = 0 then 0 else z end, 0)::bigint as residual from t3"
NEXT = f"(with s as (select user_id, pos as i, avg as v from BEFORE), {SQUEEZE} {LEVEL})"


@query(f"""
    with one as materialized (with {SAMPLES}, {SQUEEZE} {LEVEL}), two as materialized {NEXT.replace('BEFORE', 'one')}, three as materialized {NEXT.replace('BEFORE', 'two')}
    select user_id, 1::int as level, pos, residual from one union all select user_id, 2, pos, residual from two union all select user_id, 3, pos, residual from three
    union all select user_id, 0, pos, avg from three""")
def squeeze_levels(spark, sf_dir):
    """Three levels of averages and residuals."""
    return sequence.squeezed(samples(spark, sf_dir), ["user_id"], "i", "v", 3)


@query(f"with {SAMPLES} select user_id, i, coalesce(sum(v) over (partition by user_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from s")
def exclusive_prefix(spark, sf_dir):
    t = samples(spark, sf_dir)
    return t.select("user_id", "i", sequence.before("v", ["user_id"], "i").alias("start"))


@query("""
    with r as (select l_returnflag, l_orderkey, l_linenumber, row_number() over (partition by l_returnflag order by l_extendedprice / l_quantity desc, l_orderkey, l_linenumber) as rank from lineitem)
    select l_returnflag, l_orderkey, l_linenumber, rank::int as rank from r where rank <= 2""")
def best_ratios(spark, sf_dir):
    """The two largest ratios of each group."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("r"))
    return sequence.top(t, ["l_returnflag"], [F.desc("r"), F.col("l_orderkey"), F.col("l_linenumber")], 2).drop("r")


@query(f"""
    with {SAMPLES} select user_id, i, round(0.5::double * v + 0.25 * coalesce(lag(v, 1) over w, 0) - 0.125 * coalesce(lag(v, 2) over w, 0), 6) as y
    from s window w as (partition by user_id order by i)""")
def fir_filter(spark, sf_dir):
    t = samples(spark, sf_dir)
    return t.select("user_id", "i", F.round(sequence.fir("v", [0.5, 0.25, -0.125], ["user_id"], "i"), 6).alias("y"))


@query(f"with {SAMPLES} select user_id, i // 4 as frame, lag(v, 1, 0) over (partition by user_id, i % 4 order by i // 4) as carry, i from s")
def polyphase_carry(spark, sf_dir):
    """Each frame of four sees the last frame's sample of the same phase."""
    t = samples(spark, sf_dir).withColumn("frame", F.floor(F.col("i") / 4)).withColumn("phase", F.col("i") % 4)
    return t.select("user_id", "frame", F.lag("v", 1, 0).over(Window.partitionBy("user_id", "phase").orderBy("frame")).alias("carry"), "i")


@query(f"""
    with {SAMPLES}, w as (select user_id, i, v, unnest(range(greatest(0, (i - 7) // 4 + case when (i - 7) > 0 and (i - 7) % 4 <> 0 then 1 else 0 end), i // 4 + 1)) as frame from s)
    select user_id, frame::bigint as frame, sum(v)::bigint as total, count(*) as n from w group by user_id, frame""")
def sliding_frames(spark, sf_dir):
    """Frames of eight samples, a new one every four."""
    t = samples(spark, sf_dir)
    first = F.greatest(F.ceil((F.col("i") - 7) / 4), F.lit(0))
    t = t.withColumn("frame", F.explode(F.sequence(first.cast("long"), F.floor(F.col("i") / 4))))
    return t.groupBy("user_id", "frame").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"with {SAMPLES} select user_id, i // 16 as band, min(v) as low, max(v) as high, max(abs(v)) as peak, sum(v * v)::bigint as energy from s group by all")
def bands(spark, sf_dir):
    """Bands of 16 rows: extremes, peak and energy."""
    t = samples(spark, sf_dir)
    return t.groupBy("user_id", F.floor(F.col("i") / 16).alias("band")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.abs("v")).alias("peak"), F.sum(F.col("v") * F.col("v")).alias("energy"))


@query(f"""
    with {SAMPLES}, c as (select user_id, i, sum(abs(v)) over (partition by user_id order by i) as c, count(*) over (partition by user_id) as n, sum(abs(v)) over (partition by user_id) as t from s),
    j as (select distinct user_id, n, t, unnest(range(1, 100))::int as entry from c)
    select j.user_id, j.entry, least(255, 256 * c.c // j.t)::bigint as point from j join c on c.user_id = j.user_id and c.i = least(j.entry * j.n // 100, j.n - 1) where j.t > 0""")
def seek_table(spark, sf_dir):
    """Where each percent of the duration stands in the stream, in 256ths."""
    all_ = Window.partitionBy("user_id")
    t = samples(spark, sf_dir).withColumn("c", F.sum(F.abs("v")).over(all_.orderBy("i"))).withColumn("n", F.count(F.lit(1)).over(all_)).withColumn("t", F.sum(F.abs("v")).over(all_))
    wanted = t.select("user_id", "n", "t").distinct().where("t > 0").withColumn("entry", F.explode(F.sequence(F.lit(1), F.lit(99)))).withColumn("at", F.least(F.floor(F.col("entry") * F.col("n") / 100), F.col("n") - 1))
    have = t.select(F.col("user_id").alias("u"), F.col("i").alias("at_i"), "c")
    return wanted.join(have, (F.col("user_id") == F.col("u")) & (F.col("at") == F.col("at_i"))).select("user_id", "entry", F.least(F.lit(255), F.floor(256 * F.col("c") / F.col("t"))).cast("long").alias("point"))


@query(f"with {SAMPLES} select user_id, (i + 1) // 8 - 1 as entry, c as bag from (select user_id, i, sum(abs(v)) over (partition by user_id order by i)::bigint as c from s) where (i + 1) % 8 = 0")
def decimated_sums(spark, sf_dir):
    """The running sum at every eighth frame."""
    t = samples(spark, sf_dir).withColumn("bag", F.sum(F.abs("v")).over(Window.partitionBy("user_id").orderBy("i")))
    return t.where((F.col("i") + 1) % 8 == 0).select("user_id", (F.floor((F.col("i") + 1) / 8) - 1).alias("entry"), "bag")


@query(f"""
    with recursive {SAMPLES}, f as (select user_id, i, ((v % 4000) + 4000) % 4000 as bits from s),
    r as (select user_id, -1::bigint as i, 0::bigint as level, 0::bigint as stuffing from f where i = 0
          union all select user_id, i, kept - kept % 8 - more, kept % 8 + more from (
            select f.user_id, f.i, level + 2000 - least(bits, level + 2000) as kept, greatest(0, kept - kept % 8 - 4088) as more from r join f on f.user_id = r.user_id and f.i = r.i + 1))
    select user_id, i, level, stuffing from r where i >= 0""")
def bit_reservoir(spark, sf_dir):
    """A running level with a cap and drains in whole bytes, per user."""
    return folds.reservoir(samples(spark, sf_dir).withColumn("v", F.pmod("v", F.lit(4000))), "user_id", "i", "v", most=4088)


@query(f"""
    with recursive {SAMPLES}, r as (select user_id, -1::bigint as i, 0.0::double as y, 0.0::double as a, 0.0::double as b from s where i = 0
          union all select user_id, i, y, 0.5::double * v + 0.2::double * y + b, 0.25::double * v - 0.1::double * y from (
            select s.user_id, s.i, s.v, 0.25::double * s.v + r.a as y, r.b from r join s on s.user_id = r.user_id and s.i = r.i + 1))
    select user_id, i, round(y, 6) as y from r where i >= 0""")
def biquad_filter(spark, sf_dir):
    """A second-order recursive filter per user."""
    return folds.biquad(samples(spark, sf_dir), "user_id", "i", "v", (0.25, 0.5, 0.25), (-0.2, 0.1))


@query("""
    with recursive p as (select conv_id, turn, turn * 960 as gran, octet_length(encode(coalesce(text, ''))) // 255 + 1 as need, row_number() over (partition by conv_id order by turn) as i from conversations),
    r as (select distinct conv_id, 0::bigint as i, 0::bigint as turn, 0::bigint as mine, 0::bigint as need, 0::bigint as page, 0::bigint as held, 0::bigint as since, 0::bigint as now from p
          union all select conv_id, i, turn, opened, need, opened + case when need > 255 then (need + 254) // 255 when late then 1 else 0 end, case when need > 255 or late then 0 else total end, case when need > 255 or late then gran else opening end, gran from (
            select p.conv_id, p.i, p.turn, p.need, p.gran, r.held > 0 and (r.held + p.need > 255 or p.gran - r.since > 4800) as breaks, r.page + breaks::int as opened, if(breaks, 0, r.held) + p.need as total,
                   if(breaks, r.now, r.since) as opening, p.gran - opening >= 4800 as late from r join p on p.conv_id = r.conv_id and p.i = r.i + 1))
    select conv_id, turn, mine as page, need as lacing from r where i > 0""")
def page_breaks(spark, sf_dir):
    """Packets in pages of at most 255 lacing values, or when a page is late."""
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    return folds.pages(e.withColumn("granule", F.col("turn") * 960), "conv_id", "turn", "bytes", "granule", delay=4800)


@query("""
    with p as (select conv_id, turn, octet_length(encode(coalesce(text, ''))) // 255 + 1 as lacing, turn // 8 as page from conversations)
    select conv_id, page, sum(lacing)::bigint as lacing, count(*) as packets from p group by all""")
def lacing_values(spark, sf_dir):
    """Lacing values of the packets in each group of eight turns."""
    e = table(spark, sf_dir, "conversations").withColumn("lacing", F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 255) + 1)
    return e.groupBy("conv_id", F.floor(F.col("turn") / 8).alias("page")).agg(F.sum("lacing").alias("lacing"), F.count(F.lit(1)).alias("packets"))
