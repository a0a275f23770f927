"""Media sources, sinks and streams over bytes made from the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import folds, jpeg, ogg, signal
from ..sources import pnm, wav
from ..streaming import latency
from .registry import query, table


def files(spark, sf_dir, make):
    """vec_id and content: a file made of each embedding."""

    @F.pandas_udf(T.BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([make(np.asarray(v, float)) for v in x], dtype=object)

    return table(spark, sf_dir, "embeddings").select("vec_id", run("embedding").alias("content"))


@query("select vec_id, 2::int as channels, 48000::int as rate, 16::int as bits, false as is_float, (len(embedding) // 2)::bigint as frames from embeddings")
def wav_headers(spark, sf_dir):
    return wav.headers(files(spark, sf_dir, lambda v: wav.written(v[: len(v) // 2 * 2].reshape(-1, 2), 48000)), "vec_id")


@query("""
    with v as (select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as i, len(embedding) as n from embeddings)
    select vec_id, (i % 2)::int as channel, round(sum(greatest(least(round_even(x * 32768, 0), 32767), -32768) / 32768), 4) as total from v where i < n // 2 * 2 group by all""")
def wav_samples(spark, sf_dir):
    """Samples of 16-bit files, by channel."""
    t = wav.blocks(files(spark, sf_dir, lambda v: wav.written(v[: len(v) // 2 * 2].reshape(-1, 2), 48000)), "vec_id", size=16)
    return t.groupBy("vec_id", "channel").agg(F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


@query("select vec_id, 0::int as component, 0::int as by, unnest(range(0, 2))::int as bx, 64::int as n from embeddings")
def image_tiles(spark, sf_dir):
    """Tiles of gray images of 16 x 8."""
    t = pnm.tiles(files(spark, sf_dir, lambda v: pnm.written(np.resize((np.abs(v) * 255) % 256, (8, 16)))), "vec_id")
    return t.select("vec_id", "component", "by", "bx", F.size("values").alias("n"))


@query()
def image_coefficients(spark, sf_dir):
    """Quantised cosine coefficients of image tiles, and their DC plane."""
    t = pnm.tiles(files(spark, sf_dir, lambda v: pnm.written(np.resize((np.abs(v) * 255) % 256, (8, 16)))), "vec_id")
    t = t.select("vec_id", "by", "bx", signal.quantised(signal.block_dct()(F.transform("values", lambda x: x.cast("double") - 128)), F.lit(0.125), 0.6).alias("coef"))
    return t.select("vec_id", "by", "bx", F.element_at("coef", 1).alias("dc"), F.size(F.filter("coef", lambda x: x != 0)).alias("nonzero"))


def gray(v):
    return pnm.written(np.resize((np.abs(v) * 255) % 256, (8, 16)))


@query("""
    with p as (select vec_id, floor((abs(unnest(embedding)::double) * 255) % 256) as p, unnest(range(0, 64)) as i from embeddings),
    b as (select vec_id, (i // 8) % 2 as bx, (2 * sum(p) - 64 * 128) / 8 / 3 as x from p group by all),
    q as (select vec_id, bx, sign(x) * floor(abs(round(x, 9)) + 0.5) as q from b),
    d as (select vec_id, abs(q - lag(q, 1, 0) over (partition by vec_id order by bx))::bigint as d from q)
    select vec_id, (case when d = 0 then 0 else length(bin(d)) end)::int as symbol, count(*) as n from d group by all""")
def jpeg_difference_symbols(spark, sf_dir):
    """How often each size of a difference between neighbouring blocks' means is sent, for gray images of two blocks at quality 90."""
    return jpeg.symbol_histograms(files(spark, sf_dir, gray), "vec_id", "content").where("kind = 0").select("vec_id", "symbol", "n")


@query("select vec_id, 16::int as width, 8::int as height, 3::int as components, true as whole from embeddings")
def jpeg_files(spark, sf_dir):
    """Colour images as files; whole: begun and ended by their markers, and no 0xFF between them that isn't a marker's or stuffed."""
    t = jpeg.encoded(files(spark, sf_dir, lambda v: pnm.written(np.resize((np.abs(v) * 255) % 256, (8, 16, 3)))), "vec_id", "content")
    whole = F.hex("jpeg").rlike("^FFD8(FFDB0043..([0-9A-F]{2}){64}){2}FFC0.*(FFC4.*){2}FFDA000C03([0-9A-F]{2}){9}((?!FF)..|FF00)*FFD9$")
    return t.select("vec_id", "width", "height", "components", whole.alias("whole"))


@query("select conv_id, count(*) as packets, true as ordered from conversations group by conv_id")
def ogg_round_trip(spark, sf_dir):
    """Pages of each conversation's turns, parsed again: checksums hold, and all packets are there in order, byte for byte."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("packet")).withColumn("granule", F.col("turn") * 960)
    of = folds.pages(t.withColumn("size", F.octet_length("packet").cast("long")), "conv_id", "turn", "size", "granule", delay=1 << 40)
    pages = ogg.paged(t.join(of.select("conv_id", "turn", "page"), ["conv_id", "turn"]), "conv_id", "turn", "page", "packet", "granule")

    def run(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found = ogg.parse(b"".join(bytes(x) for x in pdf.sort_values("page")["bytes"]))
        packets = [x for p in found for x in p[3]]
        same = [p[1] for p in found] == list(range(len(found))) and packets == [bytes(x) for x in given.sort_values("turn")["packet"]]
        return pd.DataFrame([(given["conv_id"].iloc[0], len(packets), same)], columns=["conv_id", "packets", "ordered"])

    return pages.groupBy("stream").cogroup(t.groupBy("conv_id")).applyInPandas(run, "conv_id long, packets long, ordered boolean")


@query("""
    with e as (select event_type, time_bucket(interval '5 minutes', ts) as start, greatest(round(value * 1000)::bigint - 20000, 0) as late from events)
    select event_type, start, count(*) as frames, count(*) filter (where late > 10000) as misses, max(late) as worst, max(least(late // 2000, 63))::int as bin from e group by all""")
def streamed_latency(spark, sf_dir):
    """The windows of a stream over the events, once it has ended."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    t = latency.replay(spark, f"{sf_dir}/events.parquet", folder)
    return t.withColumn("start", F.col("start").cast("timestamp_ntz"))
