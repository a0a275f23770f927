"""WAV: headers and samples of RIFF files, read through Spark's binary file source, and a writer of PCM files.

Quirks kept: chunks other than fmt and data are skipped; a trailing partial sample is dropped; 8-bit samples are unsigned.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "channels int, rate int, bits int, is_float boolean, frames long"
BLOCK = 1152


def header(data: bytes) -> tuple[int, int, int, bool, int, int]:
    """channels, rate, bits, is_float, frames, and where samples begin; ValueError if it is no such file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            if size < 16:
                raise ValueError("a fmt chunk of under 16 bytes")
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
            if fmt[0] == 0xFFFE and size >= 40:  # extensible: the format is in the GUID
                fmt = (struct.unpack_from("<H", data, at + 32)[0], *fmt[1:])
        elif kind == b"data":
            if not fmt:
                raise ValueError("data before fmt")
            tag, channels, rate, _, _, bits = fmt
            if tag not in (1, 3) or not channels or bits not in (8, 16, 24, 32) or (tag == 3) != (bits == 32 and tag == 3):
                raise ValueError("an unsupported sample format")
            size = min(size, len(data) - at - 8)
            return channels, rate, bits, tag == 3, size // (channels * bits // 8), at + 8
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def samples(data: bytes) -> np.ndarray:
    """Frames x channels, as floats in -1..1."""
    channels, _, bits, is_float, frames, at = header(data)
    raw = np.frombuffer(data, np.uint8, frames * channels * bits // 8, at)
    if is_float:
        x = raw.view("<f4").astype(np.float32)
    elif bits == 8:
        x = (raw.astype(np.float32) - 128) / 128
    elif bits == 16:
        x = raw.view("<i2") / np.float32(32768)
    elif bits == 24:
        b = raw.reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / np.float32(8388608)
    else:
        x = raw.view("<i4") / np.float32(2147483648)
    return x.reshape(frames, channels).astype(np.float32)


def written(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit file of frames x channels in -1..1."""
    pcm = np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes()
    channels = x.shape[1]
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm


def headers(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, HEADER of each file; what is no WAV file has nulls."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                try:
                    rows.append(header(x.as_py())[:5])
                except (ValueError, TypeError, struct.error):
                    rows.append((None,) * 5)
            kinds = [pa.int32()] * 3 + [pa.bool_(), pa.int64()]
            names = ["channels", "rate", "bits", "is_float", "frames"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [key, *names])

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, {HEADER}")


def blocks(files: DataFrame, key: str = "path", content: str = "content", size: int = BLOCK) -> DataFrame:
    """key, channel, block, samples: planar blocks of `size` frames, the last shorter."""

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                x = samples(data.as_py())
                rows = [(c, b // size, x[b : b + size, c]) for b in range(0, len(x), size) for c in range(x.shape[1])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], [key, "channel", "block", "samples"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, channel int, block long, samples array<float>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or pattern, with their headers."""
    return headers(spark.read.format("binaryFile").load(path).select("path", "content"))
