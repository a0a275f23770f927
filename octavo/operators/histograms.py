"""Symbol histograms: vectorised partial counts in each task, merged by an ordinary aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_histogram(df: DataFrame, content: str, key: str) -> DataFrame:
    """key, byte, n: a task emits at most 256 rows per key it has met, so the shuffle is small whatever the bytes."""

    def run(batches):
        counts: dict = {}
        for batch in batches:
            keys, data = batch.column("key"), batch.column("data").cast(pa.large_binary())
            codes = keys.dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            for i, x in enumerate(data):
                if (raw := x.as_py()) is None:
                    continue
                k = None if at[i] != at[i] else names[int(at[i])]
                counts[k] = counts.get(k, 0) + np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        for k, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), keys.type), pa.array(some.astype(np.int32)), pa.array(n[some])], ["key", "byte", "n"])

    given = df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("data"))
    t = given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, byte int, n long")
    return t.groupBy(F.col("key").alias(key), "byte").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def row_histogram(data: pd.Series) -> pd.Series:
    """256 counts of a row's own bytes; null for null. Narrow, and nothing outlives the batch."""
    return pd.Series([None if x is None else np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in data], dtype=object)


def least_match(literals: Column) -> Column:
    """The minimum match length for that many distinct literals."""
    # The bounds at which it falls.
    return F.when(literals < 6, 9).when(literals < 8, 8).when(literals < 10, 7).when(literals < 16, 6).when(literals < 45, 5).when(literals < 80, 4).otherwise(3)


def merged(a: Column, b: Column) -> Column:
    """The sum of two histograms as arrays."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def split_delta(old: Column, new: Column) -> Column:
    """Sum of absolute differences of two histograms' shares, scaled by both totals."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.aggregate(F.zip_with(old, new, lambda o, n: F.abs(n * total(old) - o * total(new))), F.lit(0).cast("long"), lambda a, x: a + x)


def ends_block(old: Column, new: Column, length: Column) -> Column:
    """Whether new observations differ enough from the block's to end it. Integer divisions in this order."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    a, b = total(old), total(new)
    # 200 of 512, and the bounds below which short blocks end more easily.
    div = lambda x, y: F.call_function("div", x, y)
    cutoff = div(b * 200, F.lit(512)) * a
    cutoff = F.when((length < 10000) & (a + b < 8192), cutoff + div(cutoff * (8192 - a - b), F.lit(8192))).otherwise(cutoff)
    return (a > 0) & (split_delta(old, new) + div(length, F.lit(4096)) * a >= cutoff)
