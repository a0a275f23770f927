"""Text expressions with the semantics of byte-wise C strings: ASCII case, leading numbers, saturation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.translate(x, UPPER, LOWER)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def find_last(x: Column, c: str) -> Column:
    """1-based place of the last c, 0 if none."""
    back = F.instr(F.reverse(x), c)
    return F.when(back == 0, F.lit(0)).otherwise(F.length(x) - back + 1)


def leading_number(x: Column, low: int, high: int, unsigned_wrap: int | None = None) -> Column:
    """The integer that text starts with (after white space), clamped to low..high, 0 if none. unsigned_wrap: a minus sign negates modulo that."""
    sign = F.regexp_extract(x, r"^\s*([+-]?)[0-9]", 1)
    digits = F.regexp_extract(x, r"^\s*[+-]?0*([0-9]*)", 1)
    exact = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    size = F.when(F.length(digits) == 0, exact(0)).when(F.length(digits) > 20, exact(10**20)).otherwise(F.left(digits, F.lit(20)).try_cast("decimal(38,0)"))
    if unsigned_wrap:
        over = size >= exact(unsigned_wrap)
        return F.when(over, exact(high)).when((sign == "-") & (size > 0), exact(unsigned_wrap) - size).otherwise(size)
    value = F.when(sign == "-", -size).otherwise(size)
    return F.least(F.greatest(value, exact(low)), exact(high))


def to_int32(x: Column) -> Column:
    return leading_number(x, -(1 << 31), (1 << 31) - 1).cast("long")


def to_uint32(x: Column) -> Column:
    return leading_number(x, 0, (1 << 32) - 1, 1 << 32).cast("long")


def to_uint64(x: Column) -> Column:
    return leading_number(x, 0, (1 << 64) - 1, 1 << 64).cast("decimal(20,0)")


def to_double(x: Column) -> Column:
    """The decimal number that text starts with, 0 if none."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def tags(x: Column) -> Column:
    """KEY=value entries separated by semicolons, as a map."""
    return F.str_to_map(x, F.lit(";"), F.lit("="))


def printable(x: Column) -> Column:
    """Characters outside ASCII's printable range become question marks."""
    return F.regexp_replace(x, r"[^\x20-\x7E]", "?")
