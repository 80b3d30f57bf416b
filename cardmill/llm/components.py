"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (columns ``a, b``, longs, not null).

    The component is its smallest id. Each round hangs the neighbours of every id on
    the smallest of them, first the larger ones, then the smaller ones, until each hangs on
    one that hangs on none; rounds grow with the logarithm of the longest path. Minima
    are partial aggregates, joins carry rows on both sides of an exchange, so that
    AQE can split the ones of a hub, and every round is a written table.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = materialise(pairs, "links")
    while not _hung(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of an id goes to the smallest of its neighbours and itself.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        near = both.join(materialise(least, "least"), "a").filter("b > a")
        edges = materialise(near.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "large")
        # Small star: an id and its smaller neighbours go to the smallest of them.
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        near = edges.join(materialise(least, "least"), "a").select(
            F.explode(F.array(F.struct("a", "least"), F.struct(F.col("b").alias("a"), "least"))).alias("edge")
        )
        edges = near.select(F.col("edge.a").alias("a"), F.col("edge.least").alias("b")).filter("a != b")
        edges = materialise(edges.distinct(), "small")
    hung = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return hung.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _hung(edges: DataFrame) -> bool:
    """Whether every id hangs on one other, or has others hanging on it, and never both."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("on")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("on"))
    )).alias("end"))
    sides = ends.select("end.*").groupBy("id").agg(
        F.min("on").alias("low"), F.max("on").alias("high"), F.max(F.col("on").isNull()).alias("holds")
    )
    return sides.filter("low < high or (holds and low is not null)").isEmpty()
