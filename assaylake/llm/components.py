"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to (node, component), the smallest node; nodes without an edge do not occur.

    Each round ties every node's larger neighbours to its smallest one, then its smaller neighbours and itself; a chain
    shrinks to a star in a number of rounds that grows with the logarithm of its length.  Rounds are written, which cuts
    the lineage.  A node with any number of neighbours is an aggregate and a join, never one task's list.
    """
    stars = materialise(_ordered(edges, "a", "b"), "stars")
    state = _fingerprint(stars)
    while True:
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = _ordered(large, "x", "y")
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smallest, "b").select(F.col("a").alias("x"), F.col("m").alias("y")).unionByName(
            smallest.select(F.col("b").alias("x"), F.col("m").alias("y"))
        )
        stars = materialise(_ordered(small, "x", "y"), "stars")
        now = _fingerprint(stars)
        if now == state:
            break
        state = now
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def _ordered(edges: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct edges (a, b) with a < b."""
    return edges.where(F.col(x) != F.col(y)).select(
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b")
    ).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())
