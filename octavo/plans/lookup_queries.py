"""Joins by position and by table, and the relational forms next to them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import lookup
from .registry import query, table


def _values(slots):
    return "(values " + ", ".join(f"({s}, {b}, {e})" for s, b, e in slots) + ") t(slot, base, extra)"


LENGTHS, OFFSETS = bits.length_slots(), bits.offset_slots()


@query(f"""
    with s as (select *, lead(base, 1, 259) over (order by base) as next from {_values(LENGTHS)}), l as (select (3 + l_partkey % 256)::int as length from lineitem)
    select slot::int as slot, extra::int as extra, count(*) as n, sum(length - base)::bigint as rest from l join s on length >= base and length < next group by all""")
def length_slots(spark, sf_dir):
    """Match lengths to slots by a range join."""
    t = table(spark, sf_dir, "lineitem").select((3 + F.col("l_partkey") % 256).cast("int").alias("length"))
    base = F.element_at(F.array(*[F.lit(b) for _, b, _ in LENGTHS]), F.col("slot") + 1)
    return lookup.slot_join(t, "length", LENGTHS, 258).groupBy("slot", "extra").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length") - base).alias("rest"))


@query(f"""
    with s as (select *, lead(base, 1, 32769) over (order by base) as next from {_values(OFFSETS)}), l as (select (1 + l_orderkey % 32768)::int as o from lineitem)
    select slot::int as slot, count(*) as n from l join s on o >= base and o < next group by slot""")
def offset_slots(spark, sf_dir):
    """Match offsets to slots by an expression."""
    t = table(spark, sf_dir, "lineitem").select(lookup.slot((1 + F.col("l_orderkey") % 32768), OFFSETS).alias("slot"))
    return t.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query("""
    with steps as (select o_custkey as k, o_orderkey as pos, o_orderstatus as state from orders), points as (select distinct o_custkey as k, (o_orderkey + 2)::bigint as at from orders)
    select p.k, p.at, arg_max(s.state, s.pos) as state from points p join steps s on s.k = p.k and s.pos <= p.at group by all""")
def as_of_step(spark, sf_dir):
    """The last step at or before each point."""
    o = table(spark, sf_dir, "orders")
    points = o.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 2).alias("at")).distinct()
    return lookup.as_of(points, o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("state")), "k", "at", "pos", "state")


@query("""
    with u as (select l_orderkey, l_linenumber, sum(l_quantity)::bigint as q from lineitem group by all),
    p as (select l_orderkey as k, l_linenumber as part, q as size, sum(q) over (partition by l_orderkey order by l_linenumber) as upto from u),
    c as (select distinct l_orderkey as k, 20::bigint as n from lineitem)
    select c.k, c.n, p.part, (c.n - (p.upto - p.size))::bigint as "offset" from c join p on p.k = c.k and c.n >= p.upto - p.size and c.n < p.upto""")
def cursor_location(spark, sf_dir):
    """The line that holds each order's twentieth unit."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("part0")).agg(F.sum("l_quantity").cast("long").alias("size"))
    return lookup.locate(li.select("k").distinct().withColumn("n", F.lit(20).cast("long")), li, "k", "n", "part0", "size")


@query("""
    select o.o_orderkey as k, o.o_orderpriority as result, (o.o_custkey, o.o_orderstatus) is not distinct from (r.o_custkey + case when r.o_orderkey % 7 = 0 then 1 else 0 end, r.o_orderstatus) as accepted
    from orders o join orders r on o.o_orderkey = r.o_orderkey""")
def verified_speculation(spark, sf_dir):
    """Results guessed from inputs that later prove equal, or not."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("result"))
    actual = o.select("k", (F.col("a") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)).alias("a"), "b")
    return lookup.verified(o, actual, ["k"], ["a", "b"], "result")


@query("""
    with a as (select distinct l_orderkey as k from lineitem where l_linenumber = 4), b as (select o_orderkey as k, o_orderstatus as s from orders)
    select s, count(*) filter (where a.k is not null) as synced, count(*) filter (where a.k is null) as repaired from b left join a using (k) group by s""")
def reconciled(spark, sf_dir):
    """Positions found in a lane (semi join) and those to repair (anti join)."""
    lane = table(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("k"))
    pos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    found = pos.join(lane, "k", "left_semi").select("s", F.lit(1).alias("hit"))
    lost = pos.join(lane, "k", "left_anti").select("s", F.lit(0).alias("hit"))
    return found.unionByName(lost).groupBy("s").agg(F.sum("hit").alias("synced"), F.sum(1 - F.col("hit")).alias("repaired"))


@query("""
    with b as (select event_id, case when value > 75 then 'other' else event_type end as p from events where props is not null and value >= 5)
    select count(*) as frames, count(*) filter (where a.event_type is distinct from b.p) as mismatches, count(*) filter (where b.event_id is null) as missing from events a full join b using (event_id)""")
def packet_compare(spark, sf_dir):
    """Two codecs' packets by frame: all events, and those that the second kept (small values are lost to it, large ones altered)."""
    e = table(spark, sf_dir, "events")
    b = e.where("props is not null and value >= 5").select(F.col("event_id").alias("f"), F.when(F.col("value") > 75, "other").otherwise(F.col("event_type")).alias("q"))
    t = e.select("event_id", F.col("event_type").alias("p")).join(b, F.col("event_id") == F.col("f"), "full")
    return t.agg(F.count(F.lit(1)).alias("frames"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("mismatches"), F.count_if(F.col("f").isNull()).alias("missing"))


@query("""
    select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where o_orderdate >= timestamp '1995-01-01' group by n_name""")
def revenue_by_nation(spark, sf_dir):
    """A relational control: star join and aggregation."""
    li, o, c, n = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    t = t.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
    select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber from lineitem where l_tax > 0.05 except all select l_orderkey, l_linenumber from lineitem where l_discount > 0.05")
def changed_rows(spark, sf_dir):
    """Rows of one result that the other lacks."""
    t = table(spark, sf_dir, "lineitem")
    return t.where("l_tax > 0.05").select("l_orderkey", "l_linenumber").exceptAll(t.where("l_discount > 0.05").select("l_orderkey", "l_linenumber"))


@query("select conv_id, string_agg(coalesce(text, ''), '|' order by turn) as joined from conversations group by conv_id")
def ordered_parts(spark, sf_dir):
    """Parts put together in order, whatever order they arrive in."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("a"))
    return t.select("conv_id", F.array_join(F.transform("a", lambda x: x.t), "|").alias("joined"))


@query("""
    with k as (select l_shipdate::date as d, count(*) as n from lineitem group by d), c as (select d, n, sum(n) over (order by n, d) as rank from k)
    select min(rank)::bigint as low, max(rank)::bigint as high from c""")
def two_level_prefix(spark, sf_dir):
    """A global running sum from sums of ranges and sums within them: no single task sees all rows."""
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    k = k.withColumn("range", F.floor(F.log2("n")))
    sums = k.groupBy("range").agg(F.sum("n").alias("s"))  # a row a power of two
    starts = sums.select(F.col("range").alias("r"), F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    t = k.join(F.broadcast(starts), F.col("range") == F.col("r")).withColumn("rank", F.col("start") + F.sum("n").over(Window.partitionBy("range").orderBy("n", "d")))
    return t.agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
