"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being the smallest node reachable.

    Each step moves edges to smaller neighbours and writes them to the shared folder; it ends when a whole
    round changes nothing. Self-loops and repeated edges are allowed, nulls are dropped, an empty edge
    table gives an empty result. Hubs cost one pre-aggregated minimum and a join that can be split.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = None
    for k in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"cc-large{k}")
        # small star: the node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        moved = large.join(low, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.union(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), f"cc-small{k}")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
