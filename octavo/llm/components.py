"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on written tables; no link, label or
component ever reaches the driver, only a count and a checksum per round. Rounds grow
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """From links (a, b) of longs: node, root, where root is the smallest node reachable. Roots aren't listed.

    No links: no rows. Links of a node to itself, repeated links and links in both directions count once.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e, before = space.write(e, "edges"), None
    while True:
        n, check = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, check) == before or not n:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = n, check
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = space.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        e = both.join(least, F.col("u") == F.col("w")).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = space.write(e, "large")
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = space.write(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        tied = e.join(least, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = space.write(tied.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small")
