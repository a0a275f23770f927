"""Baseline JPEG files (ITU-T T.81) of gray and colour images: tokens, their histograms, optimal codes shared by clusters, one interleaved scan.

An image is a row and stays one: `encoded` is narrow, and a task holds one image at a time beside its batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.bits import zigzag
from ..sources import pnm
from .bitstream import pack
from .huffman import code_lengths, codes_of
from .signal import dct_matrix

# The tables of T.81, annex K.1, row by row, for luminance and chrominance.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
) + (99,) * 32
# Red, green, blue to luma and two differences (ITU-R BT.601), the latter around 128.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
ZIGZAG = np.array(zigzag())
SKIP_16, END_OF_BLOCK, LONGEST_CODE = 0xF0, 0x00, 16


def quantisers(quality: int, parts: int) -> list[np.ndarray]:
    """The tables scaled: quality 50 takes them as they are, 100 all ones; each value from 1 to 255."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * percent + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)[: 1 if parts == 1 else 2]]


def planes(pixels: np.ndarray) -> np.ndarray:
    """height x width x parts around zero, as luma and differences if there are three parts; edges repeated to whole blocks."""
    x = pixels.astype(float)
    x = x @ TO_YCC.T + (0, 128, 128) if x.shape[2] == 3 else x
    return np.pad(x - 128, ((0, -x.shape[0] % 8), (0, -x.shape[1] % 8), (0, 0)), "edge")


def coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """blocks x 64 quantised coefficients in zigzag order, half away from zero."""
    m, (h, w) = dct_matrix(), plane.shape
    cells = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    x = np.round((m @ cells @ m.T).reshape(-1, 64) / table, 9)  # rounded first: a tie is one whatever the sum's order
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)[:, ZIGZAG]


def _sized(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each magnitude, and the value's bits: one's complement below zero."""
    size = np.frexp(np.abs(v).astype(float))[1].astype(np.int64)
    return size, np.where(v < 0, v + (np.int64(1) << size) - 1, v)


def tokens(coefs: np.ndarray, component: int = 0) -> np.ndarray:
    """A row a token, in the order of a scan with one block of each component at a time: block, component, place, second, symbol, extra, bits."""
    n = len(coefs)
    dc = np.diff(coefs[:, 0], prepend=0)
    size, extra = _sized(dc)
    zero = np.zeros(n, np.int64)
    made = [np.stack((np.arange(n), zero, zero, size, extra, size))]
    b, k = np.nonzero(coefs[:, 1:])
    k = k + 1
    first = np.diff(b, prepend=-1) > 0
    run = k - np.where(first, 0, np.roll(k, 1)) - 1
    size, extra = _sized(coefs[b, k])
    skips = run >> 4
    none = np.zeros(int(skips.sum()), np.int64)
    made.append(np.stack((np.repeat(b, skips), np.repeat(k, skips), none, none + SKIP_16, none, none)))
    made.append(np.stack((b, k, np.ones_like(b), (run & 15) << 4 | size, extra, size)))
    open_ = np.flatnonzero(coefs[:, 63] == 0)
    none = np.zeros_like(open_)
    made.append(np.stack((open_, none + 64, none, none + END_OF_BLOCK, none, none)))
    t = np.concatenate(made, axis=1)
    t = t[:, np.lexsort((t[2], t[1], t[0]))]
    return np.stack((t[0], np.full(t.shape[1], component), *t[1:])).T


def scan(parts: list[np.ndarray]) -> np.ndarray:
    """The tokens of all components' blocks, interleaved."""
    t = np.concatenate(parts)
    return t[np.lexsort((t[:, 3], t[:, 2], t[:, 1], t[:, 0]))]


def lengths_of(histogram: np.ndarray) -> list[int]:
    """Code lengths of at most 16 bits in which no code is all ones: a reserved symbol, rarer than any other, takes that one."""
    return code_lengths([*(2 * histogram).tolist(), 1], LONGEST_CODE)[:-1]


def cost(histogram: np.ndarray) -> int:
    """Bits of a code's declaration and of the symbols under it."""
    return 8 * (17 + int((histogram > 0).sum())) + int(histogram @ np.array(lengths_of(histogram)))


def clusters(histograms: list[np.ndarray], most: int = 2) -> tuple[list[int], list[np.ndarray]]:
    """Each histogram joins the slot to which it adds least, or opens one if that is cheaper and there is room: slot by histogram, sums by slot."""
    places, slots = [], []
    for h in histograms:
        added = [(cost(s + h) - cost(s), i) for i, s in enumerate(slots)]
        if not slots or (len(slots) < most and cost(h) < min(added)[0]):
            places.append(len(slots))
            slots.append(h.copy())
        else:
            places.append(min(added)[1])
            slots[places[-1]] += h
    return places, slots


def marker(code: int, body: bytes = b"") -> bytes:
    """A marker segment; those of the file's start and end have no body and no size."""
    return bytes([0xFF, code]) + ((len(body) + 2).to_bytes(2, "big") + body if code not in (0xD8, 0xD9) else b"")


def code_table(kind: int, slot: int, lengths: list[int]) -> bytes:
    """kind 0: differences, 1: the other coefficients."""
    ordered = sorted((n, s) for s, n in enumerate(lengths) if n)
    counts = np.bincount([n for n, _ in ordered], minlength=LONGEST_CODE + 1)[1:]
    return marker(0xC4, bytes([kind << 4 | slot, *counts.tolist(), *(s for _, s in ordered)]))


def encode(pixels: np.ndarray, quality: int = 90) -> bytes:
    """height x width x 1 or 3 bytes as a file."""
    height, width, n = pixels.shape
    tables, x = quantisers(quality, n), planes(pixels)
    t = scan([tokens(coefficients(x[:, :, c], tables[min(c, 1)]), c) for c in range(n)])
    context = np.where(t[:, 2] == 0, 0, 1), t[:, 1]
    made, codes, of = [], {}, {}
    for kind in (0, 1):
        own = [np.bincount(t[(context[0] == kind) & (context[1] == c), 4], minlength=256) for c in range(n)]
        of[kind], slots = clusters(own)
        for slot, h in enumerate(slots):
            lengths = lengths_of(h)
            codes[kind, slot] = np.array(codes_of(lengths)), np.array(lengths)
            made.append(code_table(kind, slot, lengths))
    value, bits = np.zeros((len(t), 2), np.int64), np.zeros((len(t), 2), np.int64)
    for kind in (0, 1):
        for c in range(n):
            mine = (context[0] == kind) & (context[1] == c)
            code, length = codes[kind, of[kind][c]]
            value[mine, 0], bits[mine, 0] = code[t[mine, 4]], length[t[mine, 4]]
    value[:, 1], bits[:, 1] = t[:, 5], t[:, 6]
    quant = b"".join(marker(0xDB, bytes([i, *q[ZIGZAG].tolist()])) for i, q in enumerate(tables))
    frame = marker(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n)))
    start = marker(0xDA, bytes([n]) + b"".join(bytes([c + 1, of[0][c] << 4 | of[1][c]]) for c in range(n)) + bytes([0, 63, 0]))
    data = pack(value.ravel(), bits.ravel(), low_first=False, stuffed=True)
    return marker(0xD8) + quant + frame + b"".join(made) + start + data + marker(0xD9)


def encoded(df: DataFrame, key: str, content: str, quality: int = 90) -> DataFrame:
    """key, width, height, components, jpeg of PNM files. Null content gives nulls; what is no such image raises ValueError."""
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.IntegerType()) for n in ("width", "height", "components")), T.StructField("jpeg", T.BinaryType())])

    def run(batches):
        for batch in batches:
            made = []
            for data in batch.column(1).to_pylist():
                if data is None:
                    made.append((None,) * 4)
                    continue
                width, height, parts, pixels = pnm.parse(data)
                made.append((width, height, parts, encode(np.frombuffer(pixels, np.uint8).reshape(height, width, parts), quality)))
            columns = [pa.array([m[i] for m in made], pa.binary() if i == 3 else pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return df.select(key, content).mapInArrow(run, schema)


def symbol_histograms(df: DataFrame, key: str, content: str, quality: int = 90) -> DataFrame:
    """key, component, kind (0: differences, 1: the others), symbol, n: how often a file's scan holds a symbol. Null content has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                width, height, parts, pixels = pnm.parse(data)
                x, tables = planes(np.frombuffer(pixels, np.uint8).reshape(height, width, parts)), quantisers(quality, parts)
                t = np.concatenate([tokens(coefficients(x[:, :, c], tables[min(c, 1)]), c) for c in range(parts)])
                found, n = np.unique(np.stack((t[:, 1], t[:, 2] > 0, t[:, 4])), axis=1, return_counts=True)
                arrays = [pa.array([k.as_py()] * len(n), batch.schema.field(0).type), *(pa.array(c, pa.int32()) for c in found), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "component", "kind", "symbol", "n"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, component int, kind int, symbol int, n long")
