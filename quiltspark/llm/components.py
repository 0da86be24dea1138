"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands the smallest of its neighbourhood to its larger (or its other
    smaller) neighbours.  The minimum is a partial aggregate, so a node with very
    many links costs one row a task."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("_m")).withColumn("m", F.least("a", "_m")).drop("_m")
    sent = near.join(least, "a")
    if large:
        out = sent.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = sent.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b).

    Each round is written to the shared folder; rounds end when the stars no
    longer change.  The number of rounds grows with the logarithm of the longest
    chain; past ``max_rounds`` it raises."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = staged(edges, "links")
    mark = None
    for _ in range(max_rounds):
        edges = staged(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
