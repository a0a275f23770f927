"""Bytes: chunks, checksums, histograms, codes, containers, LZ77."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import checksums, chunks, containers, deflate, histograms, huffman, lz77
from .registry import query, table

BYTES = "unnest(regexp_extract_all(hex(encode(text)), '..'))"
CHUNK = 4096


def documents(spark, sf_dir, key="doc_id"):
    return table(spark, sf_dir, "documents").select(key, F.encode("text", "UTF-8").alias("content"))


@query(f"""
    with b as (select lang, ('0x' || {BYTES})::int as byte from documents), n as (select lang, byte, count(*) as n from b group by all)
    select lang, count(*) as distinct_bytes, sum(n)::bigint as total, round(-sum(n / t * log2(n / t)), 6) as entropy
    from (select *, sum(n) over (partition by lang)::double as t from n) group by lang""")
def byte_entropy(spark, sf_dir):
    """Literal frequencies per language, and their zero-order entropy."""
    n = histograms.byte_histogram(documents(spark, sf_dir, "lang"), "content", "lang")
    total = n.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_bytes"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select("lang", "distinct_bytes", "total", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("entropy"))


@query(f"""
    select lang, ('0x' || x)::int as byte, count(*) as n
    from (select lang, {BYTES} as x from documents) group by all""")
def byte_histogram(spark, sf_dir):
    return histograms.byte_histogram(documents(spark, sf_dir, "lang"), "content", "lang")


@query(f"""
    with d as (select doc_id, octet_length(encode(text))::bigint as n from documents),
    s as (select doc_id, n, unnest(range(0, greatest((n - 1024) // {CHUNK}, 0) + 1)) as chunk_id from d)
    select doc_id, chunk_id::int as chunk_id, (chunk_id * {CHUNK})::bigint as start,
           (case when (chunk_id + 1) * {CHUNK} + 1024 <= n then {CHUNK} else n - chunk_id * {CHUNK} end)::bigint as size from s""")
def chunk_plan(spark, sf_dir):
    t = chunks.chunks(documents(spark, sf_dir), "content", CHUNK, keep=("doc_id",))
    return t.select("doc_id", "chunk_id", "start", F.octet_length("bytes").cast("long").alias("size"))


@query(f"""
    select doc_id, (greatest((octet_length(encode(text)) - 1024) // {CHUNK}, 0) + 1)::bigint as n_chunks, true as equal from documents""")
def crc_combine(spark, sf_dir):
    """CRC-32 of chunks, combined in any order, against that of the whole."""
    whole = documents(spark, sf_dir).select("doc_id", "content", F.crc32("content").alias("whole"))
    t = chunks.chunks(whole, "content", CHUNK, keep=("doc_id", "whole"))
    t = t.select("doc_id", "whole", "chunk_id", F.crc32("bytes").alias("c"), F.octet_length("bytes").cast("long").alias("size"))
    n = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.first("whole").alias("whole"))
    return checksums.combined_crc(t, "doc_id", "chunk_id", "c", "size").join(n, "doc_id").select("doc_id", "n_chunks", (F.col("crc") == F.col("whole")).alias("equal"))


@query("""
    with b as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as v from documents)
    select doc_id, ((len(v) + coalesce(list_sum(list_transform(v, lambda x, i: (len(v) - i + 1) * x)), 0))::bigint % 65521 * 65536
                    + (1 + coalesce(list_sum(v), 0))::bigint % 65521)::bigint as adler from b""")
def adler32(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", checksums.adler32(checksums.byte_values(F.col("content"))).alias("adler"))


@query("""
    with t as (select list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v::bigint << 24, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, _: xor((a << 1) & 4294967295, (a >> 31) * 79764919))) as high,
        list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, _: xor(a >> 1, (a & 1) * 40961))) as low),
    p as (select page_id, list_prepend(0::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(html, ''))), '..'), lambda h: ('0x' || h)::bigint)) as b from pages)
    select page_id, list_reduce(b, lambda a, x: xor((a << 8) & 4294967295, high[xor(a >> 24, x) + 1]))::bigint as ogg, list_reduce(b, lambda a, x: xor(a >> 8, low[xor(a & 255, x) + 1]))::bigint as music from p, t""")
def ogg_and_music_crc(spark, sf_dir):
    """The unreflected 32-bit and the reflected 16-bit CRC of each page."""
    t = table(spark, sf_dir, "pages").select("page_id", checksums.other_crcs(F.encode("html", "UTF-8")).alias("c"))
    return t.select("page_id", "c.ogg", "c.music")


@query("""
    with d as (select doc_id, octet_length(encode(text)) as n, len(list_distinct(regexp_extract_all(hex(encode(text))[1:8192], '..'))) as used from documents)
    select doc_id, used::int as used, (case when n < 512 then 3 when used < 6 then 9 when used < 8 then 8 when used < 10 then 7 when used < 16 then 6 when used < 45 then 5 when used < 80 then 4 else 3 end)::int as least from d""")
def least_match_length(spark, sf_dir):
    """Distinct bytes of the first 4 KiB, and the minimum match length for them."""
    t = documents(spark, sf_dir).withColumn("used", F.size(F.array_distinct(F.regexp_extract_all(F.hex(F.substring("content", 1, 4096)), F.lit("(..)"), F.lit(1)))))
    return t.select("doc_id", "used", F.when(F.octet_length("content") < 512, 3).otherwise(histograms.least_match(F.col("used"))).alias("least"))


@query(f"""
    with n as (select lang, ('0x' || x)::int as byte, count(*) as n from (select lang, {BYTES} as x from documents) group by all)
    select lang, count(*) filter (where n > t >> 10) as common, count(*) as used from (select *, sum(n) over (partition by lang)::bigint as t from n) group by lang""")
def common_literals(spark, sf_dir):
    """Literals that aren't rare: more than a 1024th of all."""
    n = histograms.byte_histogram(documents(spark, sf_dir, "lang"), "content", "lang")
    total = n.groupBy("lang").agg(F.sum("n").alias("t")).withColumnRenamed("lang", "l")
    return n.join(total, F.col("lang").eqNullSafe(F.col("l"))).groupBy("lang").agg(F.count_if(F.col("n") > F.shiftright("t", 10)).alias("common"), F.count(F.lit(1)).alias("used"))


@query()
def huffman_codes(spark, sf_dir):
    """Length-limited canonical codes of each language's bytes."""
    n = histograms.byte_histogram(documents(spark, sf_dir, "lang").withColumn("lang", F.coalesce("lang", F.lit("none"))), "content", "lang")
    return huffman.prefix_codes(n, "lang", "byte", limit=14)


@query("""select coalesce(lang, 'none') as lang, 1.0::double as kraft, true as canonical from documents where text <> '' group by 1""")
def huffman_is_complete(spark, sf_dir):
    """The Kraft sum of each code, and whether expressions assign the same canonical codewords."""
    codes = huffman_codes(spark, sf_dir)
    return huffman.canonical(codes.withColumnRenamed("code", "given"), "lang").groupBy("lang").agg(F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"), F.bool_and(F.col("given") == F.col("code")).alias("canonical"))


@query()
def block_costs(spark, sf_dir):
    """Bits of each document's literals as a stored, static and dynamic block, and the cheapest type."""
    t = documents(spark, sf_dir).where(F.octet_length("content") > 0).select("doc_id", F.octet_length("content").cast("long").alias("length"), histograms.row_histogram("content").alias("h"))
    bits = lambda lengths: F.aggregate(F.zip_with("h", lengths, lambda n, w: n * w), F.lit(0).cast("long"), lambda x, y: x + y)
    fixed = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda s: F.when(s < 144, 8).otherwise(9))
    t = t.select("doc_id", "length", (bits(fixed) + 10).alias("static"), (bits(huffman.row_lengths("h")) + 17 + 3 * 19).alias("dynamic"))
    t = t.withColumn("stored", huffman.stored_cost(F.col("length")).cast("long"))
    return t.select("doc_id", "length", "stored", "static", "dynamic", huffman.cheapest(F.col("stored"), F.col("static"), F.col("dynamic")).alias("type"))


@query("""
    with n as (select doc_id, octet_length(encode(text))::bigint as length from documents)
    select doc_id, 35 + 40 * (((length + 65534) // 65535) - 1) + 8 * length as stored, ((length + 65534) // 65535)::bigint as blocks from n where length > 0""")
def stored_blocks(spark, sf_dir):
    """Cost and number of stored blocks of at most 65,535 bytes."""
    t = documents(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("length")).where("length > 0")
    return t.select("doc_id", huffman.stored_cost(F.col("length")).cast("long").alias("stored"), F.floor((F.col("length") + 65534) / 65535).alias("blocks"))


@query("""select doc_id, octet_length(encode(text))::bigint as size, true as header, true as trailer, true as same from documents""")
def gzip_round_trip(spark, sf_dir):
    """gzip members built from expressions around DEFLATE data, read back by the standard library."""
    t = containers.gzip(documents(spark, sf_dir), "content", level=6)
    back = containers.gunzip(F.col("gzip"))
    return t.select("doc_id", F.octet_length("content").cast("long").alias("size"), F.startswith("gzip", F.lit(b"\x1f\x8b\x08\x00")).alias("header"), (F.substring(F.col("gzip"), -8, 8) == containers.trailer(F.crc32("content"), F.octet_length("content"))).alias("trailer"), (back == F.col("content")).alias("same"))


@query("""select doc_id, octet_length(encode(coalesce(text, '')))::bigint as size, true as same, true as bounded from documents""")
def deflate_round_trip(spark, sf_dir):
    """gzip members whose bits are this package's, inflated by the standard library; bounded: not above stored blocks of each chunk."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    size = F.octet_length("content").cast("long")
    made = deflate.gzip(t, "doc_id", "content").select(F.col("doc_id").alias("d"), "gzip")
    most = 18 + size + 6 * (F.floor(size / deflate.CHUNK) + 1)
    return t.join(made, F.col("doc_id") == F.col("d")).select("doc_id", size.alias("size"), (containers.gunzip(F.col("gzip")) == F.col("content")).alias("same"), (F.octet_length("gzip") <= most).alias("bounded"))


@query("""select page_id, true as same from pages""")
def zlib_round_trip(spark, sf_dir):
    t = containers.zlib_stream(table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")), "content")
    return t.select("page_id", (containers.inflate(F.col("zlib")) == F.col("content")).alias("same"))


@query("""select doc_id, octet_length(encode(text))::bigint as size, true as same from documents""")
def lz77_replays(spark, sf_dir):
    """Steps of each chunk, replayed, are the chunk's bytes; a null text's are null."""
    t = chunks.chunks(documents(spark, sf_dir), "content", 1 << 16, keep=("doc_id",))
    t = t.withColumn("steps", lz77.parsed(F.col("bytes")))
    return t.groupBy("doc_id").agg(F.sum(F.octet_length("bytes")).alias("size"), F.bool_and(lz77.replayed(F.col("bytes"), F.col("steps")).eqNullSafe(F.col("bytes"))).alias("same"))


@query()
def lz77_statistics(spark, sf_dir):
    """Literals, matches and matched bytes by length slot."""
    t = chunks.chunks(documents(spark, sf_dir), "content", 1 << 16, keep=("doc_id",))
    n = lz77.match_counts(t, "bytes").groupBy("length").agg(F.sum("matches").alias("matches"), F.sum("literals").alias("literals"))
    slots = spark.createDataFrame(bits.length_slots(), "slot int, base int, extra int")
    nxt = F.broadcast(slots.selectExpr("slot", "base", "lead(base, 1, 259) over (order by base) as next"))
    return n.join(nxt, (F.col("length") >= F.col("base")) & (F.col("length") < F.col("next"))).groupBy("slot").agg(F.sum("matches").alias("matches"), F.sum(F.col("length") * F.col("matches")).alias("bytes"), F.sum("literals").alias("literals"))


@query(f"""
    with n as (select doc_id, byte, count(*) as n from (select doc_id, ('0x' || {BYTES})::int as byte from documents) group by all),
    k as (select *, row_number() over (partition by doc_id order by n, byte) as rank from n)
    select doc_id, byte, n, rank::int as rank from k""")
def rarest_bytes(spark, sf_dir):
    """Symbols in code order: by frequency, then symbol."""
    counted = F.transform(histograms.row_histogram("content"), lambda n, byte: F.struct(n.alias("n"), byte.alias("byte")))
    used = F.array_sort(F.filter(counted, lambda x: x["n"] > 0))
    t = documents(spark, sf_dir).select("doc_id", F.posexplode(used).alias("at", "x"))
    return t.select("doc_id", "x.byte", "x.n", (F.col("at") + 1).alias("rank"))


COUNTS = {k: ", ".join(f"count(*) filter (where doc_id % 10 = {i} and doc_id % 3 {op} 0)" for i in range(10)) for k, op in (("OLD", "="), ("NEW", "<>"))}


@query(f"""
    with d as (select source, [{COUNTS['OLD']}] as o, [{COUNTS['NEW']}] as n from documents group by source),
    t as (select *, list_sum(o)::bigint as a, list_sum(n)::bigint as b from d),
    c as (select *, list_sum(list_transform(list_zip(o, n), lambda z: abs(z[2] * a - z[1] * b)))::bigint as delta, (b * 200 // 512) * a as cut from t)
    select source, delta, a > 0 and delta >= (cut + case when a + b < 8192 then cut * (8192 - a - b) // 8192 else 0 end) as ends from c""")
def split_statistics(spark, sf_dir):
    """The test that ends a block when new observations differ from its own."""
    count = lambda i, old: F.count_if((F.col("doc_id") % 10 == i) & ((F.col("doc_id") % 3 == 0) if old else (F.col("doc_id") % 3 != 0)))
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.array(*[count(i, True) for i in range(10)]).alias("o"), F.array(*[count(i, False) for i in range(10)]).alias("n"))
    return t.select("source", histograms.split_delta(F.col("o"), F.col("n")).alias("delta"), histograms.ends_block(F.col("o"), F.col("n"), F.lit(0)).alias("ends"))
