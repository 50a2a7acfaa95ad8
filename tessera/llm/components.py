"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """Label every node of ``edges`` (columns ``a``, ``b``) with the smallest node it reaches.

    Alternates the large-star and small-star steps: each keeps connectivity and hangs
    nodes below ever smaller neighbours, so the rounds grow with the logarithm of the
    graph. Neighbours are only aggregated and joined, never gathered: a node with very
    many links costs no single task's memory. Every round is a table in the shared folder.

    Returns ``node``, ``component``; nodes without a link to another are absent. Loops,
    repeated links and nulls are ignored; an empty table gives an empty one.
    """
    step = 0
    now = ws.save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}{step}",
    )
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        large = ws.save(large, f"{name}{step}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        step += 1
        now = ws.save(small, f"{name}{step}")
        ws.drop(f"{name}{step - 1}", f"{name}{step - 2}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour only and that has none: it is then the least of its component."""
    below = edges.select(F.col("a").alias("x"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("child")))
    seen = below.groupBy("x").agg(F.sum("child").alias("n"), F.min("child").alias("lo"))
    return seen.where("n > 1 or (n = 1 and lo = 0)").isEmpty()
