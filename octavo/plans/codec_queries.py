"""Rules of encoders: bit streams, packets, rates, hearing, distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import bitstream, rangecoder
from .registry import query, table


@query("select distinct l_orderkey as a, l_partkey as b, gcd(l_orderkey, l_partkey)::bigint as divisor from lineitem")
def divisors(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return t.withColumn("divisor", codec.gcd(F.col("a"), F.col("b")))


@query("""with r as (select unnest([32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]) as rate, unnest(range(1, 15)) as place),
    q as (select distinct (l_quantity * 7)::int as asked from lineitem)
    select asked, first(rate order by abs(rate - asked), rate)::int as rate, coalesce(max(place) filter (where rate = asked), -1)::int as place from q, r group by asked""")
def bitrates(spark, sf_dir):
    asked = F.col("asked")
    t = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 7).cast("int").alias("asked")).distinct()
    return t.select("asked", codec.nearest_bitrate(asked).alias("rate"), codec.bitrate_index(asked).alias("place"))


@query("""with h as (select distinct (l_quantity * 450 + 20)::double as hertz from lineitem), k as (select unnest([0, 1, 2, 3, 4, 5]) as kind, unnest([9, -1, 0, 1, 4, 4]) as slope),
    f as (select *, case when kind = 5 then least(greatest(hertz / 1000, 3.41), 16.1) else least(greatest(hertz / 1000, 0.1), 24.0) end as f from h, k)
    select hertz, kind, round(3.64 * pow(f, -0.8) - 6.8 * exp(-0.6 * pow(f - 3.4, 2)) + 6 * exp(-0.15 * pow(f - 8.7, 2)) + (0.6 + 0.04 * slope) * 0.001 * pow(f, 4) + if(kind = 3, 6, 0), 5) as level from f""")
def hearing_thresholds(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 450 + 20).cast("double").alias("hertz")).distinct()
    levels = F.array(*[F.struct(F.lit(k).alias("kind"), F.round(codec.hearing_threshold(F.col("hertz"), k), 5).alias("level")) for k in codec.CURVES])
    return t.select("hertz", F.inline(levels))


@query("""with b as (select distinct round((l_quantity - 25) / 6, 4)::double as bark from lineitem), x as (select bark, bark * if(bark >= 0, 3.0, 1.5) as x from b),
    l as (select bark, x, if(x between 0.5 and 2.5, 8 * ((x - 0.5) * (x - 0.5) - 2 * (x - 0.5)), 0) as dip, 15.811389 + 7.5 * (x + 0.474) - 17.5 * sqrt(1 + (x + 0.474) * (x + 0.474)) as level from x)
    select bark, round(if(level <= -60, 0, exp((dip + level) * 0.2302585093) / 0.6609193), 6) as energy from l""")
def spreading_energies(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.round((F.col("l_quantity") - 25) / 6, 4).alias("bark")).distinct()
    return t.select("bark", F.round(codec.spreading(F.col("bark")), 6).alias("energy"))


@query("""with p as (select distinct (l_quantity - 25)::int as x, (l_linenumber * 3 - 10)::int as y from lineitem)
    select x, y, abs(atan2(y, x)) < 10 as near from p""")
def angle_errors(spark, sf_dir):
    """Whether the approximation lies within 0.01 of the angle."""
    x, y = F.col("x"), F.col("y")
    t = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).cast("int").alias("x"), (F.col("l_linenumber") * 3 - 10).cast("int").alias("y")).distinct()
    return t.select("x", "y", (F.abs(codec.rational_atan2(y.cast("double"), x.cast("double")) - F.atan2(y, x)) < 0.01).alias("near"))


LINES = "e as (select vec_id, list_transform(embedding, lambda v: round(v::double * 65536)) as v from embeddings)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 65536)).alias("v"))


@query(f"""with {LINES} select vec_id, round(list_sum(list_transform(v, lambda x: sqrt(abs(x) * sqrt(abs(x))))), 3) as total, round(list_max(list_transform(v, lambda x: sqrt(abs(x) * sqrt(abs(x))))), 3) as most,
    list_sum(list_transform(v, lambda x: (x - 512 * floor(x / 512 + 0.5)) * (x - 512 * floor(x / 512 + 0.5))))::double as noise from e""")
def quantiser_noise(spark, sf_dir):
    roots = F.transform("v", codec.three_quarters)
    square = lambda x: (x - 512 * F.floor(x / 512 + 0.5)) * (x - 512 * F.floor(x / 512 + 0.5))
    add = lambda a, b: a + b
    return lines(spark, sf_dir).select("vec_id", F.round(F.aggregate(roots, F.lit(0.0), add), 3).alias("total"), F.round(F.array_max(roots), 3).alias("most"), F.aggregate(F.transform("v", square), F.lit(0.0), add).alias("noise"))


@query(f"""with {LINES}, l as (select vec_id, unnest(v) as x, unnest(range(0, len(v))) as i from e)
    select vec_id, (i // 8)::int as part, sum(x * x)::double as energy, max(x * x)::double as most from l group by all""")
def partition_energies(spark, sf_dir):
    t = lines(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "x"))
    return t.groupBy("vec_id", F.floor(F.col("i") / 8).cast("int").alias("part")).agg(F.sum(F.col("x") * F.col("x")).alias("energy"), F.max(F.col("x") * F.col("x")).alias("most"))


@query(f"""with {LINES}, p as (select vec_id, v, lag(v) over (order by vec_id) as w, label from (select e.*, m.label from e join embeddings m using (vec_id))),
    s as (select vec_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) as squares, len(v) as n from p where w is not null)
    select vec_id, if(squares > 0, round(10 * log10(65536.0 * 65536.0 / (squares / n)), 6), null) as decibels from s""")
def distortion(spark, sf_dir):
    """Each signal against the one of the id before."""
    t = lines(spark, sf_dir)
    other = t.select((F.col("vec_id") + 1).alias("o"), F.col("v").alias("w"))
    squares = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return t.join(other, F.col("vec_id") == F.col("o")).select("vec_id", F.round(codec.psnr(squares, F.size("v"), 65536.0), 6).alias("decibels"))


@query("""select p_partkey, printf('%d|%05d|%s|%.3f|%x|%e', p_partkey, p_size, p_brand, p_retailprice, p_partkey, p_retailprice) as line, sign(if(p_name < p_type, -1, if(p_name > p_type, 1, 0)))::int as before,
    if(p_size % 2 = 0 or p_partkey = 0, p_partkey::decimal(20,0), 18446744073709551616 - p_partkey::decimal(20,0))::decimal(20,0) as wide from part""")
def formatted_parts(spark, sf_dir):
    before = F.when(F.col("p_name") < F.col("p_type"), -1).when(F.col("p_name") > F.col("p_type"), 1).otherwise(0)
    number = F.concat(F.when(F.col("p_size") % 2 == 0, "").otherwise("-"), F.col("p_partkey").cast("string"), F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%d|%05d|%s|%.3f|%x|%e", "p_partkey", "p_size", "p_brand", "p_retailprice", "p_partkey", "p_retailprice").alias("line"), before.alias("before"), text.to_uint64(number).alias("wide"))


FIELDS = "f as (select l_orderkey as k, l_linenumber as i, l_partkey % (1 << (l_linenumber + 5)::int) as v, (l_linenumber + 5)::int as w from lineitem)"
HEX = "array_to_string(list_transform(range(0, (length(bits) // 8)::bigint), lambda i: printf('%02X', {}::int)), '')"
BYTE = "list_sum(list_transform(range(0, 8), lambda j: substr(bits, (8 * i + j + 1)::int, 1)::int << ({})::int))"


def fields(spark, sf_dir):
    i, v = F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), i.alias("i"), (v % F.expr("shiftleft(1L, cast(l_linenumber + 5 as int))")).alias("v"), (i + 5).cast("int").alias("w"))


def gathered(t):
    t = t.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v", "w"))).alias("a"))  # the lines of an order are few
    return t.select("k", F.col("a.v").alias("v"), F.col("a.w").cast("array<int>").alias("w"))


@query(f"""with {FIELDS}, s as (select k, string_agg(reverse(right(repeat('0', 16) || bin(v), w)), '' order by i, v, w) as bits, sum(w) as n from f group by k), b as (select k, n, bits || repeat('0', ((8 - n % 8) % 8)::int) as bits from s)
    select k, n::bigint as n, {HEX.format(BYTE.format('j'))} as bytes from b""")
def low_first_streams(spark, sf_dir):
    t = bitstream.packed_fields(gathered(fields(spark, sf_dir)), "v", "w")
    return t.select("k", F.aggregate("w", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), F.hex("bytes").alias("bytes"))


@query(f"""with {FIELDS}, s as (select k, string_agg(right(repeat('0', 16) || bin(v), w), '' order by i, v, w) as bits, sum(w) as n from f group by k), b as (select k, bits || repeat('1', ((8 - n % 8) % 8)::int) as bits from s)
    select k, array_to_string(list_transform(range(0, (length(bits) // 8)::bigint), lambda i: replace(printf('%02X', {BYTE.format('7 - j')}::int), 'FF', 'FF00')), '') as bytes from b""")
def stuffed_streams(spark, sf_dir):
    t = bitstream.packed_fields(gathered(fields(spark, sf_dir)), "v", "w", low_first=False, stuffed=True)
    return t.select("k", F.hex("bytes").alias("bytes"))


@query(f"""with {FIELDS}, d as (select k, i, sum(w)::bigint as w from f group by k, i) select k, i, w, coalesce(sum(w) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from d""")
def bit_offsets(spark, sf_dir):
    t = fields(spark, sf_dir).groupBy("k", "i").agg(F.sum("w").cast("long").alias("w"))
    return t.select("k", "i", "w", bitstream.bit_offset(F.col("w"), Window.partitionBy("k").orderBy("i")).alias("start"))


@query("""with r as (select distinct l_partkey % 400 + 1 as n from lineitem)
    select n::bigint as n, (n // 138 + if(n % 138 >= 11, 1, if(n % 138 >= 3, 1, n % 138)))::bigint as zeros, (case when n < 4 then n else 1 + (n - 1) // 6 + if((n - 1) % 6 >= 3, 1, (n - 1) % 6) end)::bigint as others from r""")
def run_item_counts(spark, sf_dir):
    t, n = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 400 + 1).alias("n")).distinct(), F.col("n")
    return t.select("n", bitstream.run_items(F.lit(True), n).alias("zeros"), bitstream.run_items(F.lit(False), n).alias("others"))


@query("""with t as (select conv_id, turn, coalesce(text, '') as x from conversations)
    select conv_id, turn, count(*)::bigint as frames, max(octet_length(encode(x)))::bigint as bytes, true as same from t group by conv_id, turn""")
def merged_packets(spark, sf_dir):
    """Each turn's bytes in frames of 1,000, merged 40 to a packet and split again."""
    import pyarrow as pa

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("x"))

    def run(batches):
        for batch in batches:
            same = []
            for x in batch.column("x").to_pylist():
                frames = [x[i : i + 1000] for i in range(0, max(1, len(x)), 1000)]
                back = [f for i in range(0, len(frames), 40) for f in bitstream.split(bitstream.merge(0x80, frames[i : i + 40]))]
                same.append(back == frames)
            yield batch.append_column("same", pa.array(same, pa.bool_()))

    t = t.mapInArrow(run, "conv_id long, turn long, x binary, same boolean")
    return t.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("frames"), F.max(F.octet_length("x")).cast("long").alias("bytes"), F.every("same").alias("same"))


@query("""with t as (select doc_id, list_transform(range(0, 10), lambda d: length(regexp_replace(coalesce(text, ''), '[^' || d::varchar || ']', '', 'g'))) as h from documents)
    select doc_id, list_sum(h)::bigint as digits from t where list_sum(h) > 0""")
def used_histograms(spark, sf_dir):
    """Digit histograms that aren't empty."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.array(*[F.regexp_count(F.coalesce("text", F.lit("")), F.lit(str(d))) for d in range(10)]).alias("h"))
    return t.where(~F.forall("h", lambda x: x == 0)).select("doc_id", F.aggregate("h", F.lit(0).cast("long"), lambda a, b: a + b).alias("digits"))


@query("""with s as (select user_id, event_id, round(value * 256)::bigint as l, coalesce(lag(round(value * 256)::bigint) over (partition by user_id order by event_id), 0) as r, row_number() over (partition by user_id order by event_id) as i from events)
    select user_id, event_id, (i + 527)::bigint as place, (3 * l + r)::bigint as left_sample, (l - 3 * r)::bigint as right_sample from s""")
def scaled_samples(spark, sf_dir):
    """Two channels through a two by two transform, after a prefix of 528 zeros."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    value = F.round(F.col("value") * 256).cast("long")
    t = table(spark, sf_dir, "events").select("user_id", "event_id", value.alias("l"), F.coalesce(F.lag(value).over(by), F.lit(0)).alias("r"), F.row_number().over(by).alias("i"))
    return t.select("user_id", "event_id", (F.col("i") + 527).cast("long").alias("place"), (3 * F.col("l") + F.col("r")).alias("left_sample"), (F.col("l") - 3 * F.col("r")).alias("right_sample"))


@query("""with l as (select count(*) as n from part), s as (select row_number() over (order by p_partkey) - 1 as i, p_size from part)
    select o_orderkey, p_size::int as sample from orders, l join s on true where s.i = (o_orderkey * 31) % l.n""")
def looped_samples(spark, sf_dir):
    """A cyclic read of a loop of samples at many offsets."""
    loop = table(spark, sf_dir, "part").select((F.row_number().over(Window.orderBy("p_partkey")) - 1).cast("long").alias("i"), F.col("p_size").cast("int").alias("sample"))  # a loop is short: one second at most
    n = loop.count()
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 31 % n).alias("at")).join(loop, F.col("at") == F.col("i")).select("o_orderkey", "sample")


@query("""with b as (select i, ((i % 7919) * 31 + i % 13) % 256 as x from range(0, 300000) t(i)) select (i // 4096)::bigint as chunk, count(*)::bigint as n, sum(x)::bigint as total, sum(x * (i % 4096))::bigint as weighted from b group by 1""")
def periodic_bytes(spark, sf_dir):
    """A made-up byte stream, by chunk."""
    i = F.col("id")
    t = spark.range(300_000).select(i, ((i % 7919 * 31 + i % 13) % 256).alias("x"))
    return t.groupBy(F.floor(i / 4096).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * (i % 4096)).alias("weighted"))


@query("""with x as (select distinct l_extendedprice::double as x from lineitem), o as (select x, floor(log2(x)) + case when x < pow(2, floor(log2(x))) then -1 when x >= pow(2, floor(log2(x)) + 1) then 1 else 0 end as o from x),
    p as (select x, o, (x / pow(2.0, o) - 1) * 512 as p from o)
    select x, round(o + (1 - (p - floor(p))) * log2(1 + floor(p) / 512) + (p - floor(p)) * log2(1 + (floor(p) + 1) / 512), 6) as bits, abs(o + log2(1 + p / 512) - log2(x)) < 1e-5 as near from p""")
def interpolated_logarithms(spark, sf_dir):
    """near: within 1e-5 of the logarithm."""
    x = F.col("x")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x")).distinct()
    return t.select("x", F.round(codec.fast_log2(x), 6).alias("bits"), (F.abs(codec.fast_log2(x) - F.log2(x)) < 1e-5).alias("near"))


@query("""with f as (select l_orderkey, l_linenumber, (l_partkey % 4000)::bigint as level, (3000 + l_suppkey % 1001)::bigint as most, (l_quantity * 40)::bigint as mean from lineitem),
    e as (select *, if(level * 10 > most * 9, level - (most * 9) // 10, 0) as excess from f)
    select l_orderkey, l_linenumber, if(level * 10 > most * 9, mean + excess, mean * 9 // 10)::bigint as target, greatest(least(level, (most * 6) // 10) - excess, 0)::bigint as extra from e""")
def frame_budgets(spark, sf_dir):
    """What a frame may spend at a level of the reservoir."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4000).cast("long").alias("level"), (3000 + F.col("l_suppkey") % 1001).cast("long").alias("most"), (F.col("l_quantity") * 40).cast("long").alias("mean"))
    return t.select("l_orderkey", "l_linenumber", codec.reservoir_budget(F.col("level"), F.col("most"), F.col("mean")).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""select l_orderkey, sum(l_quantity::double) * 1000 <= sum(l_partkey)::double and count(distinct if(l_linenumber % 2 = 0, l_linestatus, null)) <= 1 as mid_side,
    (least(greatest(sum(l_partkey)::bigint - 44, 0), 100000) // (2 * 2) + 1)::bigint as samples from lineitem group by l_orderkey""")
def channel_choices(spark, sf_dir):
    """An order's lines stand in for channels: whether sum and difference are taken, and how many samples a file of its size can have."""
    agg = [(F.sum(F.col("l_quantity").cast("double")) * 1000).alias("m"), F.sum("l_partkey").cast("long").alias("p"), (F.count_distinct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus"))) <= 1).alias("same")]
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*agg)
    samples = codec.most_samples(F.col("p"), F.lit(44), F.lit(100_000), F.lit(2), F.lit(16))
    return t.select("l_orderkey", codec.takes_mid_side(F.col("m"), F.col("p").cast("double"), F.col("same")).alias("mid_side"), samples.alias("samples"))


@query("""with e as (select user_id, (row_number() over (partition by user_id order by event_id) - 1) // 64 as frame, abs(round(value * 100)::bigint) % 65536 as v from events)
    select user_id, frame::bigint as frame, count(*) as n, sum(v)::bigint as total, true as short from e group by user_id, frame""")
def range_coded_values(spark, sf_dir):
    """Each user's values in frames of 64, range coded, and their sum as it is read back from the packets; short: no more than two bytes above 16 bits a value."""
    import pyarrow as pa

    by = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, sf_dir, "events").select("user_id", F.floor((F.row_number().over(by) - 1) / 64).alias("frame"), "event_id", (F.abs(F.round(F.col("value") * 100).cast("long")) % 65536).alias("v"))
    t = t.groupBy("user_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("v"))
    call = lambda v: F.struct(F.lit("uniform").alias("kind"), v.alias("a"), F.lit(65536).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    t = rangecoder.packets(t.select(F.struct("user_id", "frame", F.size("v").alias("n")).alias("k"), F.transform("v", call).alias("calls")), "k", "calls")

    def run(batches):
        for batch in batches:
            made = []
            for n, packet in zip(batch.column("n").to_pylist(), batch.column("packet").to_pylist(), strict=True):
                d = rangecoder.Decoder(packet)
                made.append((sum(d.uniform(65536) for _ in range(n)), len(packet) <= 2 * n + 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.bool_())], ["user_id", "frame", "n", "total", "short"])

    return t.select("k.user_id", "k.frame", F.col("k.n").cast("long").alias("n"), "packet").mapInArrow(run, "user_id long, frame long, n long, total long, short boolean")
