"""Connected components of a stored edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltlog.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over ``u > v`` edges.

    Large: hang every larger neighbour of a node on the node's smallest
    neighbour. Small: hang all smaller neighbours, and the node, on the smallest.
    Smallest neighbours come from a pre-aggregated minimum, and the join back
    has one row per node on that side, so a hub may be split between tasks.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v")  # repeats go in the small step
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u long, v long``; the root is the smallest
    node that can be reached, and roots are listed too.

    Alternates large-star and small-star steps until nothing changes, a number
    of rounds that grows with the logarithm of the longest chain. Each round is
    written out, so a lost executor costs at most one round. Loops, repeated
    edges and either direction are fine; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    seen = _fingerprint(edges)
    while True:
        edges = materialize(_star(_star(edges, large=True), large=False), "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
