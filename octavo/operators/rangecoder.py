"""The range coder of Opus packets (RFC 6716, sections 4.1 and 5.1): symbols by cumulative counts, bits by odds, large uniform
numbers, Laplace-distributed ones, and recorded calls replayed.

The code is one integer of any size, so carries need no care; bytes are taken from it at the end. A packet is at most 1,275 bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the format: bits of the code before any byte is out, the range below which a byte goes out, bits of a uniform
# number coded by counts, the total of Laplace intervals, and the magnitudes that always have one.
CODE_BITS, BOTTOM, UNIFORM_BITS, TOTAL, KEPT = 31, 1 << 23, 8, 1 << 15, 16


class Encoder:
    def __init__(self):
        self.low, self.range, self.out, self.raw, self.raw_bits = 0, 1 << CODE_BITS, 0, 0, 0

    def _narrow(self, start: int, size: int):
        self.low, self.range = self.low + start, size
        while self.range <= BOTTOM:
            self.low, self.range, self.out = self.low << 8, self.range << 8, self.out + 1

    def symbol(self, low: int, high: int, total: int):
        """What lies from low to high of total; the first symbol has what division leaves."""
        unit = self.range // total
        start = self.range - unit * (total - low) if low else 0
        self._narrow(start, self.range - unit * (total - high) - start)

    def bit(self, value: int, odds: int):
        """1 in 2 ** odds."""
        rare = self.range >> odds
        self._narrow(*((self.range - rare, rare) if value else (0, self.range - rare)))

    def bits(self, value: int, n: int):
        """Uncoded, from the packet's end."""
        self.raw |= value << self.raw_bits
        self.raw_bits += n

    def uniform(self, value: int, total: int):
        """value of 0 .. total - 1: the top bits by counts, the others uncoded."""
        rest = max(0, (total - 1).bit_length() - UNIFORM_BITS)
        self.symbol(value >> rest, (value >> rest) + 1, ((total - 1) >> rest) + 1)
        self.bits(value & ((1 << rest) - 1), rest)

    def laplace(self, value: int, first: int, decay: int) -> int:
        """The number coded: value, or the farthest of its sign that has an interval."""
        found = laplace_intervals(first, decay, abs(value))
        value = value if value in found else min(found, key=lambda v: (v * value <= 0, -abs(v)))
        start, size = found[value]
        self.symbol(start, start + size, TOTAL)
        return value

    def used(self) -> int:
        """Whole bits used so far, uncoded ones included."""
        return 8 * self.out + CODE_BITS + 2 - self.range.bit_length() + self.raw_bits

    def packet(self, size: int | None = None) -> bytes:
        """The shortest code inside the range, and uncoded bits at the end of `size` bytes (at least as many as needed)."""
        kept = CODE_BITS - self.range.bit_length() + 1
        while True:
            tail = (1 << (CODE_BITS - kept)) - 1
            code = (self.low + tail) & ~tail
            if code | tail < self.low + self.range:
                break
            kept += 1
        whole = (code << 1).to_bytes(self.out + 4, "big")[: self.out + max(0, -(-kept // 8))]
        end = self.raw.to_bytes(-(-self.raw_bits // 8), "little")[::-1]
        size = len(whole) + len(end) if size is None else size
        if size < len(whole) + len(end):
            raise ValueError("the packet is too short")
        return whole + bytes(size - len(whole) - len(end)) + end


class Decoder:
    """Reads a packet; beyond its end there are zeros."""

    def __init__(self, packet: bytes):
        self.data, self.raw, self.range, self.taken = packet, int.from_bytes(packet[::-1], "little"), 1 << CODE_BITS, 4
        self.offset = int.from_bytes(packet[:4].ljust(4, b"\0"), "big") >> 1  # of the code above the range's start

    def _narrow(self, start: int, size: int):
        self.offset, self.range = self.offset - start, size
        while self.range <= BOTTOM:
            # The code's 31 bits end one bit short of a byte.
            pair = (self.data[self.taken - 1 : self.taken + 1]).ljust(2, b"\0")
            self.offset, self.range = self.offset << 8 | (pair[0] << 8 | pair[1]) >> 1 & 255, self.range << 8
            self.taken += 1

    def place(self, total: int) -> int:
        """Which of total counts the code lies in."""
        return total - min(total, (self.range - 1 - self.offset) // (self.range // total) + 1)

    def take(self, low: int, high: int, total: int):
        unit = self.range // total
        start = self.range - unit * (total - low) if low else 0
        self._narrow(start, self.range - unit * (total - high) - start)

    def bit(self, odds: int) -> int:
        rare = self.range >> odds
        value = int(self.offset >= self.range - rare)
        self._narrow(*((self.range - rare, rare) if value else (0, self.range - rare)))
        return value

    def bits(self, n: int) -> int:
        value = self.raw & ((1 << n) - 1)
        self.raw >>= n
        return value

    def uniform(self, total: int) -> int:
        rest = max(0, (total - 1).bit_length() - UNIFORM_BITS)
        parts = ((total - 1) >> rest) + 1
        top = self.place(parts)
        self.take(top, top + 1, parts)
        return top << rest | self.bits(rest)

    def laplace(self, first: int, decay: int) -> int:
        at = self.place(TOTAL)
        value, (start, size) = next((v, x) for v, x in laplace_intervals(first, decay, TOTAL).items() if x[0] <= at < x[0] + x[1])
        self.take(start, start + size, TOTAL)
        return value


def laplace_intervals(first: int, decay: int, most: int) -> dict[int, tuple[int, int]]:
    """Start and size for zero and each magnitude up to `most`, minus before plus, until the total is spent: sizes decay by decay / 2 ** 14, then are one."""
    made = {0: (0, first)}
    at, size = first, (TOTAL - 2 * KEPT - first) * ((1 << 14) - decay) >> 15
    for m in range(1, most + 1):
        for value in (-m, m):
            if at < TOTAL:
                made[value] = at, min(size + 1, TOTAL - at)
                at += size + 1
        if at >= TOTAL:
            break
        size = 2 * size * decay >> 15
    return made


def replay(calls: list[tuple[str, int, int, int]], into: Encoder | None = None) -> Encoder:
    """Recorded calls (kind and up to three numbers, as the methods take them), made again in order."""
    into = into or Encoder()
    wants = {"symbol": 3, "bit": 2, "bits": 2, "uniform": 2, "laplace": 3}
    for kind, *numbers in calls:
        getattr(into, kind)(*numbers[: wants[kind]])
    return into


CALL = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in "abc")]))


def packets(df: DataFrame, key: str, calls: str) -> DataFrame:
    """key, used, packet for each row's array of calls (CALL). Null calls make an empty packet's code; rows are independent."""
    schema = T.StructType([df.schema[key], T.StructField("used", T.LongType()), T.StructField("packet", T.BinaryType())])

    def run(batches):
        for batch in batches:
            made = [replay([(c["kind"], c["a"], c["b"], c["c"]) for c in row or []]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.used() for e in made], pa.int64()), pa.array([e.packet() for e in made], pa.binary())], schema.names)

    return df.select(key, calls).mapInArrow(run, schema)
