"""Positional joins: slot tables, cursors in prefix sums, as-of steps, verified speculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot(value: Column, table: list[tuple[int, int, int]]) -> Column:
    """The slot of a value in a table of (slot, first value, extra bits), as an expression: the table has at most some dozens of rows."""
    return F.size(F.filter(F.array(*[F.lit(base) for _, base, _ in table]), lambda b: b <= value)) - 1


def slot_join(df: DataFrame, value: str, table: list[tuple[int, int, int]], last: int) -> DataFrame:
    """Adds slot and extra by a range join with the broadcast table, whose size is fixed."""
    t = df.sparkSession.createDataFrame(table, "slot int, base int, extra int")
    t = t.withColumn("next", F.lead("base", 1, last + 1).over(Window.orderBy("base")))
    return df.join(F.broadcast(t), (F.col(value) >= F.col("base")) & (F.col(value) < F.col("next"))).drop("base", "next")


def as_of(points: DataFrame, steps: DataFrame, key: str, at: str, pos: str, value: str) -> DataFrame:
    """Adds to each point the value of the last step of its key with pos <= at: one union, one sort, and a running last value; no pairs."""
    a = points.select("*", F.lit(1).alias("_p"), F.lit(None).cast(steps.schema[value].dataType).alias("_v"))
    b = steps.select(F.col(key), F.col(pos).alias(at), F.lit(0).alias("_p"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_p = 1").drop("_p", "_v")


def locate(cursors: DataFrame, parts: DataFrame, key: str, n: str, order: str, size: str) -> DataFrame:
    """The part that holds the n-th item of its key, and the offset in it, by the parts' running sums."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(key, F.col(order).alias("part"), F.coalesce(F.sum(size).over(w), F.lit(0)).alias("_from"), F.col(size).alias("_size")).where("_size > 0")
    at = as_of(cursors, starts.withColumn("_s", F.struct("part", "_from", "_size")), key, n, "_from", "_s")
    return at.where(F.col(n) < F.col("_s._from") + F.col("_s._size")).select(*cursors.columns, "_s.part", (F.col(n) - F.col("_s._from")).alias("offset"))


def verified(speculated: DataFrame, actual: DataFrame, key: list[str], inputs: list[str], result: str) -> DataFrame:
    """Speculated results whose inputs all equal the actual ones, null for null: key, result, accepted."""
    b = actual.select(*[F.col(k).alias(f"_{k}") for k in [*key, *inputs]])
    t = speculated.join(b, [F.col(k) == F.col(f"_{k}") for k in key])
    same = F.struct(*inputs).eqNullSafe(F.struct(*[F.col(f"_{c}").alias(c) for c in inputs]))
    return t.select(*key, result, same.alias("accepted"))
