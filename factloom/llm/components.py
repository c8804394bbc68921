"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop, staged


def _largest(edges: DataFrame) -> DataFrame:
    """Large star: every neighbour above a node moves to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smallest(edges: DataFrame) -> DataFrame:
    """Small star: a node and its neighbours below move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its least node.

    The edges of each round are written to the shared folder; only their
    number and a checksum come to the driver, and the rounds end when both
    stay the same.  Edges with a null end and loops are left out.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = staged(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = state(now)
    for _ in range(rounds):
        after = staged(_smallest(_largest(now)).where("u != v").distinct(), "edges")
        found = state(after)
        drop(now)
        now = after
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    below = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = below.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._factloom_path = now._factloom_path
    return out
