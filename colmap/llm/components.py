"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmap.session import written


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node; partial minima go through the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Takes edges with u > v."""
    joined = edges.join(_least(edges), "u")
    return (
        joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(joined.select("u", F.col("m").alias("v"))).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (a, b: long) that is not itself a root.

    ``root`` is the least node of the component. Every round shuffles the edges by
    node with minima taken before the shuffle, never collects a component, and is
    written to the shared folder, so a lost executor costs at most one round. The
    number of rounds grows with the logarithm of the longest path.
    """
    edges = written(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select("u", F.col("v").alias("root"))
