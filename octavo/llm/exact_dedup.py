"""Exact dedup by distributed MSD radix partitioning.

Normalised texts are byte strings. Each round splits every group by its members' next
digit (a run of bytes; digits grow from round to round, so a text of n bytes takes
O(log n) rounds). A group of one is done; a group whose members all ended within the
digit holds equal texts and is done; the others go on with what follows the digit.
Equality comes from the bytes alone; the SHA-256 column is only returned.

Scale: a round counts (group, digit) with map-side partial sums, so a group of copies
crosses the network as one row per task, and only counts of two or more are kept and
joined back (broadcast when Spark finds them small, else a sort-merge join between
two exchanges, which AQE splits on skew). After round one only members of unfinished groups remain.

Defined cases: a null text equals the empty text; a null id loses against any id and if
all ids are null, keep_id is null; of rows that repeat id and text exactly one is kept;
an empty table gives an empty result; clashing column names stay apart in the struct `row`.
Long texts are compared whole: each sixteenfold length takes one round more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, name, packed

FIRST_DIGIT, GROWTH = 256, 16


def normalised(column):
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), SPACE, " ")


def _split(df: DataFrame, rest, width: int) -> DataFrame:
    """Adds the digit that starts rest, and whether rest ends within it."""
    return df.withColumn("digit", F.substring(rest, 1, width)).withColumn("ended", F.octet_length(rest) <= width)


def exact_duplicates(
    df: DataFrame, text: str = "text", id: str = "doc_id", columns: list[str] | None = None, first_digit: int = FIRST_DIGIT, growth: int = GROWTH
) -> DataFrame:
    """One row per input row: row (struct of `columns`, all by default), text_sha256, keep_id, group_size, kept."""
    space = Workspace(df.sparkSession)
    base = df.select(packed(df, columns).alias("row"), name(id).alias("id"), normalised(name(text)).alias("norm"), name(text).cast("string").alias("raw"))
    keep_raw = columns is not None and text not in columns
    base = _split(base, F.col("norm").cast("binary"), first_digit)
    base = base.select("row", *["raw"] * keep_raw, "id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "digit", "ended", F.monotonically_increasing_id().alias("rid"))
    base = space.write(base, "base")
    raw = F.col("raw") if keep_raw else F.col("row").getField(text)

    active, width = base.select("rid", "id", F.lit(-1).cast("long").alias("gid"), "digit", "ended", normalised(raw).cast("binary").alias("rest")), first_digit
    resolved = []
    while True:
        groups = active.groupBy("gid", "digit", "ended").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("keep_id"), F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("keep_rid"))
        groups = space.write(groups.where("size > 1"), "groups")
        if groups.isEmpty():
            break
        members = active.join(groups, ["gid", "digit", "ended"])
        rest = F.when(~F.col("ended"), F.substring(F.col("rest"), width + 1, 2**31 - 1))
        members = space.write(members.select("rid", "id", "ended", "size", "keep_id", "keep_rid", rest.alias("rest")), "members")
        resolved.append(members.where("ended").select("rid", "size", "keep_id", "keep_rid"))
        width *= growth
        active = members.where("not ended").select("rid", "id", F.col("keep_rid").alias("gid"), "rest")
        active = _split(active, F.col("rest"), width)
        if active.isEmpty():
            break

    own = base.select("rid", "row", "id", "text_sha256")
    if not resolved:
        return own.select("row", "text_sha256", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    found = resolved[0]
    for more in resolved[1:]:
        found = found.unionByName(more)
    out = own.join(found.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    return out.select(
        "row", "text_sha256", F.when(F.col("r").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("r").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
    )


def deduplicate(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the input's columns."""
    return exact_duplicates(df, text, id).where("kept").select("row.*")
