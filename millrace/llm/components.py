"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    tied = both.filter("b > a").join(least, "a")
    return tied.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them. Edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b")))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.sum(F.xxhash64("b", "a") % F.lit(1 << 40))).first())


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root for every node with an edge, but the roots; root is the least node that is reachable.

    ``edges`` has long columns a and b. Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest path. It ends when a round changes nothing, then every edge leads to a root.
    """
    now = shared.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _sum(now)
    while seen[0]:
        now = shared.save(_small_star(_large_star(now).distinct()).distinct(), name)
        before, seen = seen, _sum(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
