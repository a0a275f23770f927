"""DEFLATE streams from this package's own steps and codes (RFC 1951), a block per chunk.

Chunks become blocks of bits apart from each other. Where a block's bits start depends only on the blocks since the last stored
one, which ends on a byte, so offsets are sums over windows. A block then writes the bytes whose first bit is its own: it needs its
start within a byte and the first bits of the next block, nothing else. No task holds more than a batch of chunks, until
`streams` puts a file's parts together, which is a value of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import length_slots, offset_slots
from . import chunks, containers, lz77
from .bitstream import bits_of
from .huffman import code_lengths, codes_of

#: Bytes of a chunk; with a short last one that joins it, a chunk still fits one stored block.
CHUNK = 64000
#: Fixed values of the format: the order in which lengths of the code for code lengths are sent, and the end of a block.
ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
END, STORED_MOST = 256, 65535
LENGTH_BASE, LENGTH_EXTRA = (np.array([s[i] for s in length_slots()], np.int64) for i in (1, 2))
OFFSET_BASE, OFFSET_EXTRA = (np.array([s[i] for s in offset_slots()], np.int64) for i in (1, 2))
STATIC = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8, [5] * 30


def _reversed_codes(lengths: list[int]) -> np.ndarray:
    """Canonical codewords with their first bit lowest, as the stream wants them."""
    return np.array([int(format(c, f"0{n}b")[::-1], 2) if n else 0 for c, n in zip(codes_of(lengths), lengths, strict=True)], np.int64)


def length_items(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra value, extra bits): runs of zeros as 18 and 17, repeats of a length as 16."""
    made, i = [], 0
    while i < len(lengths):
        n = next((j for j in range(i, len(lengths)) if lengths[j] != lengths[i]), len(lengths)) - i
        i += n
        value = lengths[i - 1]
        if value:
            made.append((value, 0, 0))
            n -= 1
        while n >= 3:
            symbol, most, bits = (16, 6, 2) if value else (18, 138, 7) if n >= 11 else (17, 10, 3)
            take = min(n, most)
            made.append((symbol, take - (11 if symbol == 18 else 3), bits))
            n -= take
        made += [(value, 0, 0)] * n
    return made


def head(lit: list[int], dist: list[int]) -> list[tuple[int, int]]:
    """Fields (value, width) that declare a dynamic block's two codes."""
    items = length_items(lit + dist)
    own = code_lengths(np.bincount([s for s, _, _ in items], minlength=19).tolist(), 7)
    codes = _reversed_codes(own)
    sent = max(4, max(i + 1 for i, s in enumerate(ORDER) if own[s]))
    fields = [(len(lit) - 257, 5), (len(dist) - 1, 5), (sent - 4, 4), *((own[s], 3) for s in ORDER[:sent])]
    for s, extra, bits in items:
        fields += [(int(codes[s]), own[s]), (extra, bits)]
    return fields


def _up_to_used(lengths: list[int], least: int) -> list[int]:
    return lengths[: max(least, max((i + 1 for i, n in enumerate(lengths) if n), default=0))]


def block(data: bytes, steps: list[tuple[int, int, int]], final: bool) -> tuple[str, np.ndarray]:
    """The cheapest block's kind and its bits. A stored block's bits are its bytes alone; its header depends on where it starts."""
    s = np.array(steps, np.int64).reshape(-1, 3)
    matches = s[s[:, 1] > 0]
    # Items are literals and matches; a step's match is its last item.
    match_at = np.cumsum(s[:, 0] + (s[:, 1] > 0))[s[:, 1] > 0] - 1
    starts = np.cumsum(s[:, 0] + s[:, 1]) - s[:, 1]
    covered = np.zeros(len(data) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + s[:, 1], -1)
    literal = np.cumsum(covered[:-1]) == 0
    n = int(literal.sum()) + len(matches) + 1
    is_match = np.zeros(n, bool)
    is_match[match_at] = True
    slot = np.searchsorted(LENGTH_BASE, matches[:, 1], "right") - 1
    far = np.searchsorted(OFFSET_BASE, matches[:, 2], "right") - 1
    symbol = np.empty(n, np.int64)
    symbol[~is_match] = np.append(np.frombuffer(data, np.uint8)[literal], END)
    symbol[is_match] = END + 1 + slot

    extras = int(LENGTH_EXTRA[slot].sum() + OFFSET_EXTRA[far].sum())
    lit_n, dist_n = np.bincount(symbol, minlength=286), np.bincount(far, minlength=30)
    own = _up_to_used(code_lengths(lit_n.tolist()), 257), _up_to_used(code_lengths(dist_n.tolist()), 1)
    declared = head(*own)

    def cost(lit, dist):
        return 3 + extras + int(lit_n[: len(lit)] @ lit[:286]) + int(dist_n[: len(dist)] @ dist)

    dynamic, static = cost(*own) + sum(w for _, w in declared), cost(STATIC[0][:286], STATIC[1])
    blocks = max(1, -(-len(data) // STORED_MOST))
    if 3 + 32 + 40 * (blocks - 1) + 8 * len(data) <= min(dynamic, static):
        return "stored", np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    kind, codes, fields = ("static", STATIC, []) if static <= dynamic else ("dynamic", own, declared)
    value, width = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
    value[:, 0], width[:, 0] = _reversed_codes(codes[0])[symbol], np.array(codes[0])[symbol]
    value[is_match, 1], width[is_match, 1] = matches[:, 1] - LENGTH_BASE[slot], LENGTH_EXTRA[slot]
    value[is_match, 2], width[is_match, 2] = _reversed_codes(codes[1])[far], np.array(codes[1], np.int64)[far]
    value[is_match, 3], width[is_match, 3] = matches[:, 2] - OFFSET_BASE[far], OFFSET_EXTRA[far]
    fields = np.array([(int(final), 1), (1 if kind == "static" else 2, 2), *fields], np.int64)
    return kind, np.concatenate((bits_of(fields[:, 0], fields[:, 1], True), bits_of(value.ravel(), width.ravel(), True)))


def stored_bits(data: bytes, start: int, final: bool) -> np.ndarray:
    """Stored blocks that begin at bit `start` of a byte."""
    made = []
    for at in range(0, max(1, len(data)), STORED_MOST):
        part = data[at : at + STORED_MOST]
        flag = np.array([final and at + STORED_MOST >= len(data), 0, 0], np.uint8)
        pad = np.zeros(-((start if at == 0 else 0) + 3) % 8, np.uint8)
        size = len(part).to_bytes(2, "little") + (len(part) ^ 0xFFFF).to_bytes(2, "little")
        made += [flag, pad, np.unpackbits(np.frombuffer(size + part, np.uint8), bitorder="little")]
    return np.concatenate(made)


def blocks(parts: DataFrame, level: int = 6) -> DataFrame:
    """chunk rows (their columns, `bytes` and `final`) with kind, n_bits and bits: a stored one's n_bits lack its first header's padding."""
    lazy, depth = level >= 5, (1, 1, 2, 4, 8, 12, 16, 32, 64, 128)[level]
    fields = [T.StructField("kind", T.StringType()), T.StructField("n_bits", T.LongType()), T.StructField("bits", T.BinaryType())]

    def run(batches):
        for batch in batches:
            made = []
            for data, final in zip(batch.column("bytes"), batch.column("final"), strict=True):
                x = data.as_py()
                kind, bits = block(x, lz77.steps(x, lazy, depth), final.as_py())
                extra = 3 + 32 + 40 * (max(1, -(-len(x) // STORED_MOST)) - 1) if kind == "stored" else 0
                made.append((kind, len(bits) + extra, np.packbits(bits, bitorder="little").tobytes()))
            for i, f in enumerate(fields):
                batch = batch.append_column(f.name, pa.array([m[i] for m in made], (pa.string(), pa.int64(), pa.binary())[i]))
            yield batch

    return parts.mapInArrow(run, T.StructType([*parts.schema.fields, *fields]))


def placed(df: DataFrame, key: str, chunk: str = "chunk_id") -> DataFrame:
    """Adds start_bit. A stored block ends on a byte, so the bit within a byte counts from the last one on; its padding follows from it."""
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    t = df.withColumn("_run", F.coalesce(F.count_if(F.col("kind") == "stored").over(before), F.lit(0)))
    inside = Window.partitionBy(key, "_run").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    # A run's first block follows a stored one or nothing: its stored block can only be the last of the run.
    t = t.withColumn("_bit", F.coalesce(F.sum("n_bits").over(inside), F.lit(0)) % 8)
    t = t.withColumn("n_bits", F.col("n_bits") + F.when(F.col("kind") == "stored", F.pmod(-(F.col("_bit") + 3), F.lit(8))).otherwise(0))
    return t.withColumn("start_bit", F.coalesce(F.sum("n_bits").over(before), F.lit(0)).cast("long")).drop("_run", "_bit")


@F.pandas_udf(T.BinaryType())
def _spliced(kind: pd.Series, bits: pd.Series, n: pd.Series, start: pd.Series, final: pd.Series, next_kind: pd.Series, next_bits: pd.Series, next_final: pd.Series) -> pd.Series:
    def one(kind, bits, n, start, final, after, ahead, last):
        shift = start % 8
        own = stored_bits(bits, shift, final) if kind == "stored" else np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[:n]
        skip = -shift % 8  # these bits lie in a byte of the block before
        own = own[skip:]
        need = -len(own) % 8
        if need and after is not None:
            # Any block has ten bits or more, so that a byte holds no more than two blocks; a stored one starts with its flag and zeros.
            more = np.array([last, 0, 0, 0, 0, 0, 0, 0], np.uint8) if after == "stored" else np.unpackbits(np.frombuffer(ahead, np.uint8), bitorder="little")
            own = np.concatenate((own, more[:need]))
        return np.packbits(own, bitorder="little").tobytes()

    return pd.Series([one(*row) for row in zip(kind, bits, n, start, final, next_kind, next_bits, next_final, strict=True)], dtype=object)


def parts(df: DataFrame, key: str, content: str, chunk: int = CHUNK, level: int = 6) -> DataFrame:
    """key, chunk_id, kind, n_bits, start_bit, part: each block's bytes of the file's stream, in order. Null content has none."""
    t = df.where(F.col(content).isNotNull()).select(F.col(key), F.col(content).alias("_c"), F.size(chunks.chunk_starts(F.octet_length(content).cast("long"), chunk, chunks.LEAST_LAST)).alias("_n"))
    t = chunks.chunks(t, "_c", chunk, keep=(key, "_n")).withColumn("final", F.col("chunk_id") == F.col("_n") - 1).drop("_n", "start")
    t = blocks(t, level).withColumn("bits", F.when(F.col("kind") == "stored", F.col("bytes")).otherwise(F.col("bits"))).drop("bytes")
    order = Window.partitionBy(key).orderBy("chunk_id")
    t = placed(t, key)
    ahead = [F.lead(c).over(order) for c in (F.col("kind"), F.substring(F.col("bits"), 1, 2), F.col("final"))]
    t = t.select("*", *(c.alias(n) for c, n in zip(ahead, ("_k", "_b", "_f"), strict=True)))
    part = _spliced("kind", "bits", "n_bits", "start_bit", "final", "_k", "_b", F.coalesce("_f", F.lit(False)))
    return t.select(key, "chunk_id", "kind", "n_bits", "start_bit", part.alias("part"))


def streams(made: DataFrame, key: str) -> DataFrame:
    """key, deflate, blocks, n_bits: a file's parts in order."""
    t = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "part"))).alias("p"), F.count(F.lit(1)).alias("blocks"), F.sum("n_bits").alias("n_bits"))
    return t.select(key, F.aggregate(F.col("p.part"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("deflate"), "blocks", "n_bits")


def gzip(df: DataFrame, key: str, content: str, chunk: int = CHUNK, level: int = 6) -> DataFrame:
    """key, gzip: one member of own bits, for each row whose content is not null. Keys are unique."""
    ends: Column = containers.trailer(F.crc32(content), F.octet_length(content))
    whole = df.where(F.col(content).isNotNull()).select(F.col(key).alias("_key"), ends.alias("_t"))
    t = streams(parts(df, key, content, chunk, level), key).join(whole, F.col(key) == F.col("_key"))
    return t.select(key, F.concat(containers.header(level), "deflate", "_t").alias("gzip"))
