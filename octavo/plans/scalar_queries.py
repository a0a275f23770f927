"""Scalar functions: bits, fixed point, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, text
from .registry import query, table

KEYS = "k as (select l_orderkey as a, l_partkey as b, l_linenumber as c from lineitem)"


def keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("c"))


@query(f"""with {KEYS} select a, b, c, (length(bin(a + 1)) - 1)::int as top, ((a * 16777 + b) % 4294967296 * 506832829 % 4294967296 >> 17)::bigint as hash,
    ((a * 2654435761 + 2147483648) % 4294967296 - 2147483648)::bigint as wrapped, least(a * 100000 + 2000000000, 2147483647)::bigint as saturated from k""")
def integer_bits(spark, sf_dir):
    t, a, b = keys(spark, sf_dir), F.col("a"), F.col("b")
    word = F.pmod(a * 16777 + b, F.lit(1 << 32))
    return t.select("a", "b", "c", bits.top_bit(a + 1).alias("top"), bits.sequence_hash(word, 15).alias("hash"), bits.wrap32(a * 2654435761).alias("wrapped"), bits.saturating_add(a * 100000, F.lit(2000000000)).alias("saturated"))


@query(f"""with {KEYS} select distinct b % 4096 as x, list_sum(list_transform(range(0, 12), lambda i: ((b % 4096) >> i::int & 1) << (11 - i::int)))::bigint as reversed from k""")
def reversed_bits(spark, sf_dir):
    x = F.col("b") % 4096
    return keys(spark, sf_dir).select(x.alias("x"), bits.reverse_bits(x, F.lit(12)).alias("reversed")).distinct()


@query(f"""with {KEYS}, s as (select distinct (b % 256)::int as symbol from k) select symbol, (case when symbol & 15 <> 0 then symbol & 15 when symbol >> 4 = 15 then 0 else symbol >> 4 end)::int as extra from s""")
def category_bits(spark, sf_dir):
    s = (F.col("b") % 256).cast("int")
    return keys(spark, sf_dir).select(s.alias("symbol")).distinct().select("symbol", bits.category_bits(F.col("symbol")).alias("extra"))


@query(f"""with {KEYS}, s as (select distinct b as seed from k) select seed, ((seed * 196314165 + 907633515 + 2147483648) % 4294967296 - 2147483648)::bigint as next from s""")
def random_states(spark, sf_dir):
    return keys(spark, sf_dir).select(F.col("b").alias("seed")).distinct().select("seed", bits.next_random(F.col("seed")).alias("next"))


@query(f"""with {KEYS}, s as (select distinct a as x from k where a > 0) select x, abs(x - s * s) <= 0.35 * x + 64 as near, abs(l / 128.0 - log2(x)) < 0.04 as close
    from (select x, true as t, sqrt(x) as s, 128 * log2(x) as l from s)""")
def fixed_point(spark, sf_dir):
    """Approximations of roots and logarithms, held against the functions themselves."""
    x = F.col("x")
    t = keys(spark, sf_dir).select(F.col("a").alias("x")).distinct().where("x > 0")
    return t.select("x", (F.abs(x - F.pow(bits.sqrt_fixed(x), F.lit(2))) <= 0.35 * x + 64).alias("near"), (F.abs(bits.log2_q7(x) / 128 - F.log2(x)) < 0.04).alias("close"))


@query(f"""with {KEYS}, s as (select distinct (b % 500 - 250) as x from k), t as (select x, least(abs(x) // 32, 5) as i, abs(x) % 32 as r, [237, 153, 73, 30, 12, 7] as s, [16384, 23955, 28861, 31213, 32178, 32548] as p, [16384, 8812, 3906, 1554, 589, 219] as n from s)
    select x, (case when x <= -192 then 0 when x >= 192 then 32767 when x < 0 then n[i + 1] - s[i + 1] * r else p[i + 1] + s[i + 1] * r end)::bigint as y from t""")
def sigmoid(spark, sf_dir):
    t = keys(spark, sf_dir).select((F.col("b") % 500 - 250).alias("x")).distinct()
    return t.select("x", bits.sigmoid_q15(F.col("x")).alias("y"))


@query(f"""with {KEYS}, s as (select distinct (b % 256)::int as toc from k)
    select toc, (case when toc & 128 <> 0 then 48000 * (1 << (toc >> 3 & 3)) // 400 when toc & 96 = 96 then case when toc & 8 <> 0 then 960 else 480 end when toc >> 3 & 3 = 3 then 2880 else 48000 * (1 << (toc >> 3 & 3)) // 100 end)::bigint as samples from s""")
def packet_samples(spark, sf_dir):
    t = keys(spark, sf_dir).select((F.col("b") % 256).cast("int").alias("toc")).distinct()
    return t.select("toc", bits.samples_per_frame(F.col("toc"), 48000).alias("samples"))


@query(f"""with {KEYS}, s as (select distinct (b % 121)::int as q from k) select q, round(case when q >= 100 then 0.01 when q >= 30 then 0.1 + (100 - q) * 0.09 else 53.0::double / 3000 * q * q - 23.0::double / 20 * q + 25 end, 6)::double as distance from s""")
def quality_distance(spark, sf_dir):
    t = keys(spark, sf_dir).select((F.col("b") % 121).cast("int").alias("q")).distinct()
    return t.select("q", F.round(bits.quality_to_distance(F.col("q")), 6).alias("distance"))


@query(f"""with {KEYS} select distinct a, lower(hex(a)) as h, round(a / 10000.0, 4)::double as ms from k""")
def packed_integers(spark, sf_dir):
    t = keys(spark, sf_dir).select("a").distinct()
    return t.select("a", F.lower(F.regexp_replace(F.hex(bits.big_endian32(F.col("a"))), "^0+(?=.)", "")).alias("h"), F.round(F.col("a") / 10000.0, 4).alias("ms"))


@query("""with c as (select c_custkey, c_name, c_mktsegment as s from customer)
    select c_custkey, length(c_name) as n, case when strpos(reverse(c_name), '#') = 0 then 0 else length(c_name) - strpos(reverse(c_name), '#') + 1 end as last, strpos(c_name, 'u') as first,
           translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'building' as building, left(c_name, 8) as cut, regexp_replace(c_name, '[^ -~]', '?', 'g') as clean from c""")
def text_functions(spark, sf_dir):
    t, s = table(spark, sf_dir, "customer"), F.col("c_name")
    return t.select("c_custkey", F.length(s).cast("long").alias("n"), text.find_last(s, "#").cast("long").alias("last"), F.instr(s, "u").cast("long").alias("first"), text.equal_ignoring_case(F.col("c_mktsegment"), F.lit("Building")).alias("building"), F.left(s, F.lit(8)).alias("cut"), text.printable(s).alias("clean"))


@query("""with c as (select c_custkey, c_acctbal, cast(c_custkey as varchar) || 'x' as p from customer)
    select c_custkey, c_custkey as i, case when c_custkey = 0 then 0 else 4294967296 - c_custkey end as u, 2147483647::bigint as top, (c_custkey + 0.5)::double as d from c""")
def number_parsing(spark, sf_dir):
    """Leading numbers with C's saturation and wrapping."""
    k = F.col("c_custkey").cast("string")
    t = table(spark, sf_dir, "customer")
    return t.select("c_custkey", text.to_int32(F.concat(F.lit(" "), k, F.lit("x"))).alias("i"), text.to_uint32(F.concat(F.lit("-"), k)).alias("u"), text.to_int32(F.concat(F.lit("99999999999"), k)).alias("top"), text.to_double(F.concat(k, F.lit(".5z"))).alias("d"))


@query("select c_custkey, c_name as title, c_mktsegment as genre from customer")
def tag_maps(spark, sf_dir):
    """Comments of the form KEY=value, written and read as a map."""
    t = table(spark, sf_dir, "customer").withColumn("m", text.tags(F.concat(F.lit("TITLE="), "c_name", F.lit(";GENRE="), "c_mktsegment")))
    return t.select("c_custkey", F.col("m")["TITLE"].alias("title"), F.col("m")["GENRE"].alias("genre"))
