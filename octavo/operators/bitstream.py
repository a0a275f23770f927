"""Streams of bits: fields packed from either end of a byte, their offsets, runs of code lengths, and packets of frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


def bits_of(values: np.ndarray, widths: np.ndarray, low_first: bool) -> np.ndarray:
    """One entry per bit of all fields, in order."""
    total = int(widths.sum())
    own = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    shift = own if low_first else np.repeat(widths, widths) - 1 - own
    return (np.repeat(values, widths) >> shift & 1).astype(np.uint8)


def pack(values: np.ndarray, widths: np.ndarray, low_first: bool = True, stuffed: bool = False) -> bytes:
    """The fields' bits in bytes, zeros at the end. stuffed: a zero byte follows each 0xFF, as in scans of images, where ones fill the last byte."""
    bits = bits_of(np.asarray(values, np.int64), np.asarray(widths, np.int64), low_first)
    if stuffed:
        bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
    made = np.packbits(bits, bitorder="little" if low_first else "big")
    return made.tobytes().replace(b"\xff", b"\xff\x00") if stuffed else made.tobytes()


def packed_fields(df: DataFrame, values: str, widths: str, low_first: bool = True, stuffed: bool = False) -> DataFrame:
    """df (its other columns of any kind) with `bytes`: the arrays of values and widths packed, by row. Null arrays are empty."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(values), batch.column(widths), strict=True)
            made = [pack(np.array(v.as_py() or [], np.int64), np.array(w.as_py() or [], np.int64), low_first, stuffed) for v, w in pairs]
            yield batch.append_column("bytes", pa.array(made, pa.binary()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("bytes", BinaryType())]))


def bit_offset(width: Column, over) -> Column:
    """The bit at which a field starts: the sum of the widths before it."""
    return F.coalesce(F.sum(width).over(over.rowsBetween(-(2**31), -1)), F.lit(0)).cast("long")


def run_items(zero: Column, n: Column) -> Column:
    """How many items a run of n equal code lengths takes. Zeros: 11 to 138 at once, then 3 to 10; others: the length, then 3 to 6 repeats of it."""
    longest = F.floor(n / 138) + F.when(n % 138 >= 11, 1).otherwise(0)
    rest = F.when(n % 138 >= 11, 0).otherwise(n % 138)
    zeros = longest + F.when(rest >= 3, 1).otherwise(rest)
    more, left = F.floor((n - 1) / 6), (n - 1) % 6
    others = F.when(n < 4, n).otherwise(1 + more + F.when(left >= 3, 1).otherwise(left))
    return F.when(zero, zeros).otherwise(others).cast("long")


#: Fixed values of the packet format: samples of a frame at 48 kHz at most, bytes of a frame at most, and the size from which a second byte is used.
MOST_SAMPLES, MOST_BYTES, TWO_BYTES = 5760, 1275, 252


def frame_samples(toc: int) -> int:
    """Samples of a frame at 48 kHz: by the top five bits."""
    config = toc >> 3
    if config >= 16:
        return 120 << (config & 3)
    return (480 << (config & 1)) if config >= 12 else (480, 960, 1920, 2880)[config & 3]


def _sized(n: int) -> bytes:
    return bytes([n]) if n < TWO_BYTES else bytes([TWO_BYTES + (n & 3), (n - TWO_BYTES - (n & 3)) >> 2])


def merge(toc: int, frames: list[bytes]) -> bytes:
    """One packet of frames of the same kind: alone, two equal, two, or a count with or without sizes."""
    sizes = [len(f) for f in frames]
    if not frames or max(sizes) > MOST_BYTES or len(frames) * frame_samples(toc) > MOST_SAMPLES:
        raise ValueError("frames don't fit one packet")
    toc, equal, body = toc & 0xFC, len(set(sizes)) == 1, b"".join(frames)
    if len(frames) == 1:
        return bytes([toc]) + body
    if len(frames) == 2:
        return bytes([toc | 1]) + body if equal else bytes([toc | 2]) + _sized(sizes[0]) + body
    return bytes([toc | 3, len(frames) | (0 if equal else 0x80)]) + (b"" if equal else b"".join(map(_sized, sizes[:-1]))) + body


def split(packet: bytes) -> list[bytes]:
    """The frames of a packet, its padding left out; ValueError if it is not well formed."""
    if not packet:
        raise ValueError("empty")
    code, at, count, padding, flags = packet[0] & 3, 1, (1, 2, 2, 0)[packet[0] & 3], 0, 0
    if code == 3:
        flags = packet[1] if len(packet) > 1 else 0
        count, at = flags & 63, 2
        if not count or count * frame_samples(packet[0]) > MOST_SAMPLES:
            raise ValueError("count")
        while flags & 0x40:
            if at >= len(packet):
                raise ValueError("padding")
            step = packet[at]
            at, padding = at + 1, padding + min(step, 254)
            if step < 255:
                break
    sizes = []
    for _ in range(count - 1 if code == 2 or flags & 0x80 else 0):
        head = packet[at : at + 2]
        if not head or head[0] >= TWO_BYTES and len(head) < 2:
            raise ValueError("size")
        sizes.append(head[0] if head[0] < TWO_BYTES else head[0] + 4 * head[1])
        at += 1 if head[0] < TWO_BYTES else 2
    left = len(packet) - padding - at
    if not sizes and count > 1:
        if left < 0 or left % count:
            raise ValueError("sizes differ")
        sizes = [left // count] * (count - 1)
    sizes.append(left - sum(sizes))
    if min(sizes) < 0 or sizes[-1] > MOST_BYTES:
        raise ValueError("sizes")
    ends = np.cumsum([at, *sizes]).tolist()
    return [packet[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def pulse_counts(n: int, k: int) -> list[list[int]]:
    """vectors[i][j]: how many integer vectors of i places have magnitudes that sum to j."""
    vectors = [[1] + [0] * k]
    for _ in range(n):
        last, row = vectors[-1], [1]
        for j in range(1, k + 1):  # without a last place's pulse, with one more of it, or with its first
            row.append(last[j] + row[j - 1] + last[j - 1])
        vectors.append(row)
    return vectors


def pulse_index(y: list[int]) -> int:
    """The place of a vector among all of as many places and pulses, from the last place on: smaller magnitudes first, and plus before minus."""
    n, k = len(y), sum(map(abs, y))
    vectors, found, left = pulse_counts(n, k), 0, k
    for j, v in enumerate(y):
        rest = vectors[n - 1 - j]
        found += sum(rest[left - m] * (1 if m == 0 else 2) for m in range(abs(v)))
        left -= abs(v)
        found += rest[left] if v < 0 else 0
    return found
