"""Ordered folds per key, where each step needs the one before: clamped levels, recursive filters, page breaks.

A key's rows go to one task in order, in Arrow batches: only the state is held, not the group.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: str, columns: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """step(state, order, *columns) -> (state, row) for each row of a key in order. schema: of key, order and the row's fields."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            out = []
            for k, i, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    at, state = k, start()
                state, row = step(state, i, *values)
                out.append((k, i, *row))
            if out:
                kinds = [batch.schema.field(0).type, batch.schema.field(1).type]
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) if n < 2 else pa.array(x) for n, x in enumerate(zip(*out, strict=True))], names)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, order, *columns).repartition(n, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def reservoir(df: DataFrame, key: str, order: str, spent: str, most: int, mean: int = 2000) -> DataFrame:
    """Adds up what each frame leaves of its mean bits. The level is a multiple of eight of at most `most`; the rest is stuffing."""

    def step(level, _, bits):
        level += mean - min(bits, level + mean)
        stuffing = level % 8
        stuffing += max(0, level - stuffing - most)
        return level - stuffing, (level - stuffing, stuffing)

    return fold(df, key, order, [spent], int, step, f"{key} long, {order} long, level long, stuffing long")


def biquad(df: DataFrame, key: str, order: str, value: str, b: tuple[float, float, float], a: tuple[float, float]) -> DataFrame:
    """Direct form II transposed."""

    def step(state, _, x):
        y = b[0] * x + state[0]
        return (b[1] * x - a[0] * y + state[1], b[2] * x - a[1] * y), (round(y, 6),)

    return fold(df, key, order, [value], lambda: (0.0, 0.0), step, f"{key} long, {order} long, y double")


def iir(df: DataFrame, key: str, order: str, value: str, stages: list[tuple[list[float], list[float]]]) -> DataFrame:
    """y after recursive filters one after another, each (b, a): y[n] = b0 x[n] + b1 x[n-1] + ... - a1 y[n-1] - a2 y[n-2] - ..., from silence. The state is two short queues a filter."""

    def start():
        return [(deque([0.0] * len(b), len(b)), deque([0.0] * len(a), len(a))) for b, a in stages]

    def step(state, _, x):
        for (xs, ys), (b, a) in zip(state, stages, strict=True):
            xs.appendleft(x)
            x = sum(map(mul, b, xs)) - sum(map(mul, a, ys))
            ys.appendleft(x)
        return state, (x,)

    return fold(df, key, order, [value], start, step, f"{key} long, {order} long, y double")


def pages(df: DataFrame, key: str, order: str, size: str, granule: str, delay: int) -> DataFrame:
    """The (first) page of each packet: a page holds 255 lacing values, and closes once it spans `delay`. A packet of more has pages of its own."""

    def step(state, _, n, at):
        page, lacing, last, now = state
        need = (n or 0) // 255 + 1
        if lacing and (lacing + need > 255 or at - last > delay):
            page, lacing, last = page + 1, 0, now
        mine, lacing = page, lacing + need
        if need > 255:
            page, lacing, last = page + (need + 254) // 255, 0, at
        elif at - last >= delay:
            page, lacing, last = page + 1, 0, at
        return (page, lacing, last, at), (mine, need)

    return fold(df, key, order, [size, granule], lambda: (0, 0, 0, 0), step, f"{key} long, {order} long, page long, lacing long")
