"""Prefix codes of histograms: length-limited code lengths, canonical codewords, and block costs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def code_lengths(freqs: list[int], limit: int = 15) -> list[int]:
    """Lengths of a prefix code. Ties: leaves before inner nodes, lower symbols first. With fewer than two symbols, two codes of one bit."""
    used = [(f, s) for s, f in enumerate(freqs) if f]
    lengths = [0] * len(freqs)
    if len(used) < 2:
        only = used[0][1] if used else 0
        for s in (only, 1 if only == 0 else 0):
            if s < len(lengths):
                lengths[s] = 1
        return lengths
    heap = [(f, 0, s, s) for f, s in used]  # frequency, inner, order, node
    heapq.heapify(heap)
    parts: dict[int, tuple[int, int]] = {}
    node = len(freqs)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parts[node] = a[3], b[3]
        heapq.heappush(heap, (a[0] + b[0], 1, node, node))
        node += 1
    counts, stack = [0] * (limit + 1), [(node - 1, 0)]
    while stack:
        at, depth = stack.pop()
        if at in parts:
            stack += [(x, depth + 1) for x in parts[at]]
        else:
            counts[min(depth, limit)] += 1
    # Depths cut to the limit oversubscribe the code: give a shorter code one bit more until it fits.
    space = sum(n << (limit - d) for d, n in enumerate(counts))
    while space > 1 << limit:
        d = next(d for d in range(limit - 1, 0, -1) if counts[d])
        counts[d] -= 1
        counts[d + 1] += 2
        counts[limit] -= 1
        space -= 1
    rank = iter(s for _, s in sorted(used))
    for d in range(limit, 0, -1):
        for _ in range(counts[d]):
            lengths[next(rank)] = d
    return lengths


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def row_lengths(histogram: pd.Series) -> pd.Series:
    """Code lengths of at most 15 bits for a row's histogram; null for null."""
    return pd.Series([None if h is None else code_lengths([int(n) for n in h]) for h in histogram], dtype=object)


def codes_of(lengths: list[int]) -> list[int]:
    """Canonical codewords: by length, then symbol."""
    made, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        made[s], last = code, n
        code += 1
    return made


def prefix_codes(df: DataFrame, key: str, symbol: str = "symbol", freq: str = "n", symbols: int = 256, limit: int = 15) -> DataFrame:
    """key, symbol, n, len, code for each used symbol. A group is one alphabet: at most `symbols` rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        freqs = [0] * symbols
        for s, n in zip(pdf[symbol], pdf[freq], strict=True):
            freqs[int(s)] = int(n)
        lengths = code_lengths(freqs, limit)
        codes = codes_of(lengths)
        rows = [(pdf[key].iloc[0], s, freqs[s], lengths[s], codes[s]) for s in range(symbols) if lengths[s]]
        return pd.DataFrame(rows, columns=[key, "symbol", "n", "len", "code"])

    return df.select(key, symbol, freq).groupBy(key).applyInPandas(run, f"{key} {kind}, symbol int, n long, len int, code long")


def canonical(df: DataFrame, key: str) -> DataFrame:
    """Adds code to (key, symbol, len) in expressions alone: a rank within the length, and first codes from the counts of shorter lengths."""
    counts = df.groupBy(key).agg(F.collect_list("len").alias("lens")).select(F.col(key).alias("_k"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.size(F.filter("lens", lambda x: x == n))).alias("_c"))
    first = F.aggregate(F.sequence(F.lit(1), F.col("len")), F.lit(0).cast("long"), lambda a, n: (a + F.when(n > 1, F.element_at("_c", n)).otherwise(F.lit(0))) * 2)
    rank = F.row_number().over(Window.partitionBy(key, "len").orderBy("symbol")) - 1
    return df.join(counts, F.col(key) == F.col("_k")).withColumn("code", first + rank).drop("_k", "_c")


def cheapest(stored: Column, static: Column, dynamic: Column) -> Column:
    """The block type of least cost; ties: stored, then static."""
    return F.when((stored <= static) & (stored <= dynamic), "stored").when(static <= dynamic, "static").otherwise("dynamic")


def stored_cost(length: Column) -> Column:
    """Bits of stored blocks without alignment."""
    return 3 + 32 + 40 * (F.floor((length + 0xFFFE) / 0xFFFF) - 1) + 8 * length
