"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, component) for every node of ``edges`` (by, a, b); component
    is the least node that can be reached within the same ``by``.

    Large-star: each node points its greater neighbours to the least node
    around it. Small-star: each node points its lesser neighbours, and itself,
    to the least of them. Each round both steps halve distances, so the rounds
    grow with the logarithm of the longest chain; the edges never become more.
    It ends when every node but the centres has one edge, to its centre. A node
    with many edges is aggregated map-side, and is one key of joins that
    adaptive execution splits; rounds are cut by stored tables."""
    by = list(by)
    left = materialize(edges.filter("a <> b").select(
        *by, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "star-edges")
    nodes = edges.select(*by, F.col("a").alias("node")).union(edges.select(*by, F.col("b"))).distinct()
    while not _stars(left, by):
        # the least node around lo: of its lesser neighbours or itself
        least = left.groupBy(*by, F.col("hi").alias("lo")).agg(F.min("lo").alias("_m"))
        large = left.join(least, [*by, "lo"], "left").select(
            *by, "hi", F.coalesce("_m", "lo").alias("lo")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy(*by, "hi").agg(F.min("lo").alias("_m"))
        small = large.join(least, [*by, "hi"]).select(
            *by, F.explode(F.array(F.struct("hi", F.col("_m").alias("lo")),
                                   F.struct(F.col("lo").alias("hi"), F.col("_m").alias("lo")))).alias("e"))
        new = materialize(small.select(*by, "e.hi", "e.lo").filter("hi <> lo").distinct(), "small-star")
        discard(left)
        discard(large)
        left = new
    return nodes.join(left.select(*by, F.col("hi").alias("node"), "lo"), [*by, "node"], "left").select(
        *by, "node", F.coalesce("lo", "node").alias("component"))


def _stars(edges: DataFrame, by: list[str]) -> bool:
    """Whether each greater end has one edge and no edge hangs on another."""
    twice = edges.groupBy(*by, "hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hung = edges.select(*by, F.col("lo").alias("hi")).join(edges.select(*by, "hi"), [*by, "hi"], "left_semi")
    return twice.select("hi").union(hung.select("hi")).isEmpty()
