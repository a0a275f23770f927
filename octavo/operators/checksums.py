"""Checksums with associative merges.

CRC-32 is linear over GF(2): the CRC of a concatenation is the exclusive or of each chunk's CRC advanced by
the bytes after it, so chunks merge in any order. Adler-32 has a closed form in sums of bytes and of weighted bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFLECTED = 0xEDB88320
ADLER = 65521


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _squares() -> list[list[int]]:
    """Matrices that advance a reflected CRC by 2^k zero bytes."""
    one = [REFLECTED] + [1 << i for i in range(31)]  # one zero bit
    made = []
    for _ in range(3 + 48):
        made.append(one)
        one = [_times(one, row) for row in one]
    return made[3:]


SQUARES = _squares()


def advance(crc: int, zeros: int) -> int:
    """The CRC's contribution after that many more bytes."""
    k = 0
    while zeros:
        if zeros & 1:
            crc = _times(SQUARES[k], crc)
        zeros, k = zeros >> 1, k + 1
    return crc


@F.pandas_udf(T.LongType())
def advanced(crc: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([advance(int(c), int(z)) for c, z in zip(crc, zeros, strict=True)], dtype="int64")


def combined_crc(chunks: DataFrame, key: str, order: str, crc: str, size: str) -> DataFrame:
    """key, crc of the concatenation in order. One window for the bytes after each chunk, then one partial aggregation."""
    after = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    t = chunks.withColumn("_after", F.coalesce(after, F.lit(0)))
    return t.groupBy(key).agg(F.bit_xor(advanced(F.col(crc), F.col("_after"))).alias("crc"))


def adler32(bytes_: Column) -> Column:
    """From an array of byte values: s2 << 16 | s1."""
    start = F.struct(F.lit(1).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))
    sums = F.aggregate(bytes_, start, lambda a, b: F.struct((a.s1 + b).alias("s1"), (a.s2 + a.s1 + b).alias("s2")))
    return F.transform(F.array(sums), lambda s: F.shiftleft(F.pmod(s.s2, F.lit(ADLER)), 16).bitwiseOR(F.pmod(s.s1, F.lit(ADLER))))[0]


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of longs."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))


def _table(polynomial: int, width: int, reflected: bool) -> list[int]:
    top, mask, table = 1 << (width - 1), (1 << width) - 1, []
    for i in range(256):
        c = i if reflected else i << (width - 8)
        for _ in range(8):
            c = (c >> 1 ^ polynomial if c & 1 else c >> 1) if reflected else (c << 1 ^ polynomial if c & top else c << 1)
        table.append(c & mask)
    return table


def ogg_crc(data: bytes) -> int:
    """Polynomial 0x04C11DB7, most significant bit first, from 0."""
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ OGG[crc >> 24 ^ b]
    return crc


def music_crc(data: bytes, crc: int = 0) -> int:
    """CRC-16 with polynomial 0xA001, reflected."""
    for b in data:
        crc = crc >> 8 ^ MUSIC[(crc ^ b) & 0xFF]
    return crc


OGG, MUSIC = _table(0x04C11DB7, 32, False), _table(0xA001, 16, True)


@F.pandas_udf(T.StructType([T.StructField("ogg", T.LongType()), T.StructField("music", T.LongType())]))
def other_crcs(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"ogg": [ogg_crc(x or b"") for x in data], "music": [music_crc(x or b"") for x in data]})
