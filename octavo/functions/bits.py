"""Bit and fixed-point expressions on BIGINT columns that hold unsigned or signed 32-bit values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32


def wrap32(x: Column) -> Column:
    """x modulo 2^32 as a signed 32-bit value."""
    return F.pmod(x + F.lit(1 << 31), F.lit(U32)) - F.lit(1 << 31)


def saturate32(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-(1 << 31))), F.lit((1 << 31) - 1))


def saturating_add(a: Column, b: Column) -> Column:
    return saturate32(a.cast("long") + b.cast("long"))


def wrapping_add(a: Column, b: Column) -> Column:
    return wrap32(a.cast("long") + b.cast("long"))


def next_random(seed: Column) -> Column:
    """The next state of the linear congruential generator, signed."""
    # Multiplier and increment.
    return wrap32(wrap32(seed.cast("long")) * F.lit(196314165) + F.lit(907633515))


def top_bit(x: Column) -> Column:
    """Position of the highest set bit of x > 0; null for 0."""
    return F.when(x > 0, F.length(F.bin(x)) - 1)


def leading_zeros32(x: Column) -> Column:
    return F.when(x == 0, F.lit(32)).otherwise(32 - F.length(F.bin(x)))


def reverse_bits(x: Column, n: Column) -> Column:
    """The lowest n bits of x in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x.bitwiseAND(F.expr("1L") * 0 + F.shiftleft(F.lit(1).cast("long"), 40) - 1)), n, "0")), 2, 10).cast("long")


def sequence_hash(x: Column, bits: int) -> Column:
    """A multiplicative hash of a 32-bit word."""
    # Fixed value: the multiplier.
    return F.shiftright(F.pmod(x.cast("long") * F.lit(0x1E35A7BD), F.lit(U32)), 32 - bits)


def category_bits(symbol: Column) -> Column:
    """Extra bits of a run/size symbol: its size, or the run of an end-of-band symbol."""
    size, run = symbol.bitwiseAND(F.lit(15)), F.shiftright(symbol, 4)
    return F.when(size != 0, size).when(run == 15, F.lit(0)).otherwise(run)


def holds_ff(data: Column) -> Column:
    """Whether any byte is 255."""
    return F.hex(data).rlike("^(?:..)*FF")


def big_endian32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def little_endian32(x: Column) -> Column:
    return F.reverse_bytes(x) if hasattr(F, "reverse_bytes") else F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))


def _scaled(a: Column, b: Column) -> Column:
    """(a * b) >> 16 with the low 16 bits of b."""
    return F.shiftright(a * b, 16)


def _fraction7(x: Column) -> Column:
    """The seven bits after the leading one of x > 0."""
    shift = top_bit(x)
    return F.when(shift >= 7, F.expr("0L") + F.floor(x / F.pow(F.lit(2.0), shift - 7))).otherwise(x * F.pow(F.lit(2.0), 7 - shift)).cast("long").bitwiseAND(F.lit(127))


def log2_q7(x: Column) -> Column:
    """128 * log2(x), in parabolic pieces, for x > 0."""
    # Fixed value: 179, the curvature.
    frac = _fraction7(x)
    return frac + _scaled(frac * (128 - frac), F.lit(179)) + top_bit(x) * 128


def sqrt_fixed(x: Column) -> Column:
    """An integer square root within some percent; 0 for x <= 0."""
    # 2^15, 2^15 * sqrt(2), and 213.
    zeros = leading_zeros32(x)
    y = F.when(zeros % 2 != 0, F.lit(32768.0)).otherwise(F.lit(46214.0))
    y = F.floor(y / F.pow(F.lit(2.0), F.floor(zeros / 2))).cast("long")
    return F.when(x <= 0, F.lit(0).cast("long")).otherwise(y + _scaled(y, F.lit(213) * _fraction7(x)))


def sigmoid_q15(x: Column) -> Column:
    """A sigmoid in Q15 of x in Q5, in straight pieces of 32."""
    # Slopes, and the values at the pieces' ends on both sides.
    slopes, above, below = [237, 153, 73, 30, 12, 7], [16384, 23955, 28861, 31213, 32178, 32548], [16384, 8812, 3906, 1554, 589, 219]
    at = lambda table, i: F.element_at(F.array(*[F.lit(v) for v in table]), i + 1)
    a = F.abs(x)
    i, rest = F.least(F.shiftright(a, 5), F.lit(5)).cast("int"), a.bitwiseAND(F.lit(31))
    inside = F.when(x < 0, at(below, i) - at(slopes, i) * rest).otherwise(at(above, i) + at(slopes, i) * rest)
    return F.when(x <= -192, F.lit(0)).when(x >= 192, F.lit(32767)).otherwise(inside).cast("long")


def quality_to_distance(q: Column) -> Column:
    """A JPEG quality as a perceptual distance."""
    # The pieces' coefficients.
    return F.when(q >= 100, F.lit(0.01)).when(q >= 30, 0.1 + (100 - q) * 0.09).otherwise(53.0 / 3000.0 * q * q - 23.0 / 20.0 * q + 25.0)


def samples_per_frame(toc: Column, rate: int) -> Column:
    """Samples in one frame of an Opus packet, from its first byte."""
    size = F.shiftright(toc, 3).bitwiseAND(F.lit(3))
    return (
        F.when(toc.bitwiseAND(F.lit(0x80)) != 0, F.floor(rate * F.pow(F.lit(2), size) / 400))
        .when(toc.bitwiseAND(F.lit(0x60)) == 0x60, F.when(toc.bitwiseAND(F.lit(8)) != 0, F.lit(rate // 50)).otherwise(F.lit(rate // 100)))
        .when(size == 3, F.lit(rate * 60 // 1000))
        .otherwise(F.floor(rate * F.pow(F.lit(2), size) / 100))
    ).cast("long")


def length_slots() -> list[tuple[int, int, int]]:
    """DEFLATE match lengths (RFC 1951, 3.2.5): slot, first length, extra bits."""
    made, base = [], 3
    for slot in range(28):
        extra = max(0, slot // 4 - 1)
        made.append((slot, base, extra))
        base += 1 << extra
    return [*made, (28, 258, 0)]


def offset_slots() -> list[tuple[int, int, int]]:
    """DEFLATE match offsets: slot, first offset, extra bits."""
    made, base = [], 1
    for slot in range(30):
        extra = max(0, slot // 2 - 1)
        made.append((slot, base, extra))
        base += 1 << extra
    return made


def zigzag(n: int = 8) -> list[int]:
    """Cells of an n x n block along its diagonals."""
    return [y * n + x for x, y in sorted(((x, y) for y in range(n) for x in range(n)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 == 0 else c[1]))]
