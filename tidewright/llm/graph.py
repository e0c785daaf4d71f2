"""Connected components of an edge table, by distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, parts, stored

#: Edges of a file; edges whose nodes' minima are few enough to broadcast.
EDGES_A_FILE, FEW_EDGES = 200_000, 50_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, u: str, v: str, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same:
    a number of rounds that follows the logarithm of the longest path. Every
    step groups by a node with a map-side minimum and joins the minimum back.
    The minima of all nodes, while edges are counted to be few, or else those
    of nodes with over a thousandth of the edges, are broadcast, so a node of
    any degree is neither collected, nor joined in one task, nor paired with
    itself. Each round is written to the shared folder. Null ends and loops are ignored.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        if before[0] <= few:
            return rows.join(F.broadcast(least.drop("degree")), "u")
        return join_hot(rows, cut(least), "u", "degree")

    # Rounds never add edges, so few edges need few files.
    files = min(parts(edges.sparkSession), 1 + before[0] // EDGES_A_FILE)
    for _ in range(max_rounds):
        # Large star: hang every larger neighbour of a node on the least node around it.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: hang every smaller neighbour and the node itself on its least neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = with_least(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    itself = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(itself)
