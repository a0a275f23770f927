"""gzip and zlib containers around DEFLATE data. The DEFLATE bits are the standard library's, not a given encoder's."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import big_endian32, little_endian32
from .checksums import adler32, byte_values


def header(level: int) -> Column:
    """Ten bytes: no time, the level's flag, unknown system."""
    flag = 4 if level <= 1 else 2 if level >= 9 else 0
    return F.lit(bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, flag, 255]))


def trailer(crc: Column, size: Column) -> Column:
    return F.concat(little_endian32(crc), little_endian32(F.pmod(size.cast("long"), F.lit(1 << 32))))


def deflate(content: Column, level: int = 6) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        def one(x):
            made = zlib.compressobj(level, zlib.DEFLATED, -15)
            return made.compress(x) + made.flush()

        return pd.Series([None if x is None else one(x) for x in data], dtype=object)

    return run(content)


def _reader(wbits: int):
    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else zlib.decompress(x, wbits) for x in data], dtype=object)

    return run


gunzip, inflate, inflate_raw = _reader(31), _reader(15), _reader(-15)


def gzip(df: DataFrame, content: str, level: int = 6) -> DataFrame:
    """Adds gzip: one member."""
    c = F.col(content)
    return df.withColumn("gzip", F.concat(header(level), deflate(c, level), trailer(F.crc32(c), F.octet_length(c))))


def zlib_stream(df: DataFrame, content: str, level: int = 6) -> DataFrame:
    """Adds zlib: two bytes, DEFLATE data, and a big-endian Adler-32."""
    c = F.col(content)
    return df.withColumn("zlib", F.concat(F.lit(b"\x78\x9c"), deflate(c, level), big_endian32(adler32(byte_values(c)))))
