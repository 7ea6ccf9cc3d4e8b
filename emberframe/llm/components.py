"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.settle import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); component is the smallest node reachable.

    Each round hangs every neighbour on the smallest node around (large star), then every node on its
    smallest lower neighbour (small star). The number of edges never grows and about log2 of the diameter
    rounds are needed. Minima combine before the shuffle and the joins back on a node may be split by the
    skew join, so a hub with a third of all edges is no single task. Each round is a written table, so
    lineage stays short and a lost executor costs one round. Null ends and loops are ignored; no edges give
    an empty result.
    """
    star = settle(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    mark = _mark(star)
    while mark[0]:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        lower = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star = settle(lower.union(lowest).distinct())
        before, mark = mark, _mark(star)
        if mark == before:
            break
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        star.select("lo", "lo").distinct()
    )


def _mark(star: DataFrame) -> tuple:
    """Size and order-free digest of an edge table; the same for two equal tables."""
    digest = F.xxhash64("hi", "lo")
    return tuple(star.agg(F.count("*"), F.bit_xor(digest), F.sum(digest.cast("decimal(20,0)"))).first())
