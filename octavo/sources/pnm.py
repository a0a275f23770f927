"""PNM: binary gray (P5) and colour (P6) images of at most 255, read through Spark's binary file source."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def parse(data: bytes) -> tuple[int, int, int, bytes]:
    """width, height, components, pixels; ValueError if it is no such image or cut off."""
    m = HEADER.match(data)
    if not m or int(m[4]) != 255 or not int(m[2]) or not int(m[3]):
        raise ValueError("not a binary PNM image of 8 bits")
    width, height, parts = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    pixels = data[m.end() : m.end() + width * height * parts]
    if len(pixels) < width * height * parts:
        raise ValueError("the image is cut off")
    return width, height, parts, pixels


def written(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, width, height) + pixels.astype(np.uint8).tobytes()


def tiles(files: DataFrame, key: str = "path", content: str = "content", size: int = 8) -> DataFrame:
    """key, component, by, bx, values: tiles of size x size, the edges repeated; narrow, a tile a row."""

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                width, height, parts, pixels = parse(data.as_py())
                x = np.frombuffer(pixels, np.uint8).reshape(height, width, parts)
                x = np.pad(x, ((0, -height % size), (0, -width % size), (0, 0)), "edge")
                rows = [(c, y // size, z // size, x[y : y + size, z : z + size, c].ravel()) for c in range(parts) for y in range(0, len(x), size) for z in range(0, x.shape[1], size)]
                arrays = [pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)), pa.array([r[3].astype(np.int16) for r in rows], pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "component", "by", "bx", "values"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, component int, by int, bx int, values array<smallint>")


def read_tiles(spark: SparkSession, path: str, size: int = 8) -> DataFrame:
    return tiles(spark.read.format("binaryFile").load(path).select("path", "content"), size=size)
