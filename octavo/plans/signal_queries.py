"""Signals: embeddings stand in for short frames, events for channels of samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import loudness, signal
from .registry import query, table
from .sequence_queries import SAMPLES, samples

WINDOW = 8


@query(f"""
    with {SAMPLES}, w as (select user_id, i // {WINDOW} as k, sum(v * v)::bigint as e from s group by all having count(*) = {WINDOW}),
    b as (select l.user_id // 2 as title, least(greatest(floor(1000 * log10((l.e + r.e) / {WINDOW} * 0.5 + 1e-37)), 0), 11999)::bigint as bin
          from w l join w r on l.user_id % 2 = 0 and r.user_id = l.user_id + 1 and l.k = r.k),
    n as (select title, bin, count(*) as n from b group by all), c as (select *, sum(n) over (partition by title order by bin desc) as cum, sum(n) over (partition by title) as t from n)
    select title, 64.82 - max(bin) / 100 as gain from c where cum >= ceil(round(t * 0.05, 9)) group by title""")
def title_gain(spark, sf_dir):
    """Two users are the channels of a title: energies by window, joined, binned, and the level of the loudest 5 %."""
    e = loudness.energies(samples(spark, sf_dir), ["user_id"], "i", "v", WINDOW)
    left = e.where("user_id % 2 = 0").select(F.floor(F.col("user_id") / 2).alias("title"), "k", "energy")
    right = e.where("user_id % 2 = 1").select(F.floor(F.col("user_id") / 2).alias("t"), F.col("k").alias("j"), F.col("energy").alias("r"))
    both = left.join(right, (F.col("title") == F.col("t")) & (F.col("k") == F.col("j")))
    return loudness.title_gain(both.select("title", loudness.level_bin(F.col("energy"), F.col("r"), WINDOW).alias("bin")), "title", "bin")


@query(f"""
    with recursive {SAMPLES}, k as (select {list(loudness.YULE[44100])}::double[] as yule, {list(loudness.BUTTER[44100])}::double[] as butter),
    r as (select user_id, -1::bigint as i, list_transform(range(0, 10), lambda j: 0.0::double) as x, list_transform(range(0, 10), lambda j: 0.0::double) as y, [0.0::double, 0.0] as z from s where i = 0
          union all select user_id, i, xs[2:], list_append(y[2:], w), [z[2], butter[5] * w + butter[3] * y[10] + butter[1] * y[9] - butter[4] * z[2] - butter[2] * z[1]] from (
            select s.user_id, s.i, list_append(r.x, s.v::double) as xs, r.y, r.z, k.butter, list_dot_product(xs, k.yule[:11]) - list_dot_product(r.y, k.yule[12:]) as w from r join s on s.user_id = r.user_id and s.i = r.i + 1, k))
    select user_id, i, round(z[2], 3) as y from r where i >= 0""")
def weighted_samples(spark, sf_dir):
    """Each user's samples through the loudness filters of 44.1 kHz."""
    t = loudness.weighted(samples(spark, sf_dir).select("user_id", "i", F.col("v").cast("double").alias("v")), "user_id", "i", "v")
    return t.withColumn("y", F.round("y", 3))


@query("""
    select a.label, round(sum(list_dot_product(a.embedding::double[], b.embedding::double[])), 3) as total, count(*) as n
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by a.label""")
def neighbour_products(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select(F.col("vec_id").alias("v"), F.col("embedding").alias("e"))
    return a.join(b, F.col("v") == F.col("vec_id") + 1).groupBy("label").agg(F.round(F.sum(signal.dot(F.col("embedding"), F.col("e"))), 3).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""
    select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as energy, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) as peak,
           list_max(list_transform(embedding, lambda x: abs(x::double))) <= 1.0 / 16 as silent from embeddings""")
def signal_energy(spark, sf_dir):
    t, e = table(spark, sf_dir, "embeddings"), F.col("embedding")
    return t.select("vec_id", F.round(signal.energy(e), 5).alias("energy"), F.round(signal.peak(e), 6).alias("peak"), signal.silent(e, 4).alias("silent"))


@query("""
    with p as (select vec_id, unnest(range(1, len(embedding) // 2 + 1)) as k, embedding as e from embeddings)
    select vec_id, round(sum(power((e[2 * k - 1]::double + e[2 * k]) / sqrt(2), 2)), 4) as low, round(sum(power((e[2 * k - 1]::double - e[2 * k]) / sqrt(2), 2)), 4) as high from p group by vec_id""")
def haar_bands(spark, sf_dir):
    """Energies of the sums and the differences of neighbours."""
    t = table(spark, sf_dir, "embeddings").withColumn("h", signal.haar(F.col("embedding")))
    part = lambda odd: F.round(signal.energy(F.filter("h", lambda _, i: i % 2 == odd)), 4)
    return t.select("vec_id", part(0).alias("low"), part(1).alias("high"))


@query("select vec_id, round(1.0::double, 6) as norm from embeddings where list_sum(list_transform(embedding, lambda x: abs(x::double))) > 0")
def unit_vectors(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").where(signal.energy(F.col("embedding")) > 0)
    return t.select("vec_id", F.round(F.sqrt(signal.energy(signal.normalised(F.col("embedding")))), 6).alias("norm"))


@query("""
    with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), l as (select *, unnest(range(0, 4)) as lag from v)
    select vec_id, lag::int as lag, round(list_sum(list_transform(range(1, (len(e) - lag + 1)::bigint), lambda i: e[i] * e[i + lag])), 4) as r from l""")
def autocorrelations(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.autocorrelation(4)(F.col("embedding"))).alias("lag", "x"))
    return t.select("vec_id", "lag", F.round("x", 4).alias("r"))


@query("""select vec_id, true as parseval, true as hartley, true as dct from embeddings""")
def transforms_keep_energy(spark, sf_dir):
    """Fourier, Hartley and cosine transforms against the energy of the samples."""
    e = F.col("embedding")
    t = table(spark, sf_dir, "embeddings").withColumn("e", signal.energy(e)).withColumn("n", F.size(e))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    power, near = signal.power_spectrum(e), lambda a, b: F.abs(a - b) <= 1e-6 * (F.abs(b) + 1)
    t = t.withColumn("p", power).withColumn("h", signal.hartley_transform(e)).withColumn("d", signal.block_dct()(e))
    inner = (2 * total("p") - F.element_at("p", 1) - F.when(F.col("n") % 2 == 0, F.element_at("p", -1)).otherwise(0.0)) / F.col("n")
    return t.select("vec_id", near(inner, F.col("e")).alias("parseval"), near(signal.energy(F.col("h")) / F.col("n"), F.col("e")).alias("hartley"), near(signal.energy(F.col("d")), signal.energy(F.slice(e, 1, 64))).alias("dct"))


@query()
def quantised_blocks(spark, sf_dir):
    """Cosine coefficients of 8 x 8 blocks, quantised, and how many are not zero."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", signal.quantised(signal.block_dct()(F.col("embedding")), F.lit(16.0), 0.6).alias("q"))
    return t.select("vec_id", F.size(F.filter("q", lambda x: x != 0)).alias("nonzero"), F.element_at("q", 1).alias("dc"))


@query("""
    with v as (select vec_id, embedding::double[] as v, unnest(range(0, 3)) as block from embeddings), k as (select unnest(range(0, 16)) as k),
    m as (select k, list_transform(range(0, 32), lambda t: sin(pi() / 32 * (t + 0.5)) * cos(pi() / 16 * (t + 8.5) * (k + 0.5))) as row from k),
    c as (select vec_id, block, list_dot_product(v[16 * block + 1 : 16 * block + 32], row) as c from v, m where len(v) >= 16 * block + 32)
    select vec_id, block::int as block, round(sum(c * c), 6) as energy from c group by all""")
def lapped_transform(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.mdct(16)(F.col("embedding"))).alias("block", "c"))
    return t.select("vec_id", "block", F.round(signal.energy(F.col("c")), 6).alias("energy"))


@query("""select vec_id, (len(embedding) * 3 // 2)::int as n from embeddings""")
def resampled_length(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.size(signal.resampled(3, 2)(F.col("embedding"))).alias("n"))


@query()
def resampled_signal(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.transform(signal.resampled(3, 2)(F.col("embedding")), lambda x: F.round(x, 6)).alias("y"))


@query()
def linear_prediction(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.transform(signal.levinson(4)(F.col("embedding")), lambda x: F.round(x, 6)).alias("a"), signal.best_pitch(2, 16)(F.col("embedding")).alias("pitch"))


@query("select vec_id, 8::bigint as pulses from embeddings")
def pulse_vectors(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.aggregate(signal.pulses(8)(F.col("embedding")), F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("pulses"))


@query("""
    with f as (select distinct (l_partkey % 200 * 100)::double as freq from lineitem)
    select freq, round(13 * atan(0.76 * freq * 0.001) + 3.5 * atan(freq * 0.001 * freq * 0.001 / 56.25), 6) as bark from f""")
def bark_scale(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200 * 100).cast("double").alias("freq")).distinct()
    return t.select("freq", F.round(signal.bark(F.col("freq")), 6).alias("bark"))


@query("""
    with v as (select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as i from embeddings)
    select vec_id, i // 8 as band, round(sqrt(sum(x * x)), 5) as amplitude from v group by all""")
def band_amplitudes(spark, sf_dir):
    """The root of each band's energy."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return t.groupBy("vec_id", F.floor(F.col("i") / 8).alias("band")).agg(F.round(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))), 5).alias("amplitude"))


@query("""
    with m as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)
    select vec_id, round((a + c * 0.5) * 2 / 3, 6) as l, round((b + c * 0.5) * 2 / 3, 6) as r from m""")
def downmix_channels(spark, sf_dir):
    """Three channels to two, the rows scaled to the number of outputs."""
    t = table(spark, sf_dir, "embeddings")
    m = signal.downmix(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), [[1.0, 0.0, 0.5], [0.0, 1.0, 0.5]])
    return t.select("vec_id", F.round(m[0], 6).alias("l"), F.round(m[1], 6).alias("r"))


@query(f"with {SAMPLES} select user_id, i, v from (select *, max(abs(v)) over (partition by user_id order by i rows between 3 preceding and 3 following) as m from s) where abs(v) = m")
def attack_peaks(spark, sf_dir):
    """Samples that are the largest of the seven around them."""
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-3, 3)
    return samples(spark, sf_dir).withColumn("m", F.max(F.abs("v")).over(w)).where("abs(v) = m").select("user_id", "i", "v")
