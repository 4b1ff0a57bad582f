"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.session import staged


def _digest(edges: DataFrame) -> tuple:
    """What tells two sets of distinct edges apart, without moving them."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(2 ** 31))), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node it can reach.

    Large-star and small-star steps in turn: a node's neighbours are tied to the
    smallest of them, never to each other, so a round makes no more edges than it
    read. A hub's minimum is an aggregate that is combined before the shuffle; the
    join that hands it back to the hub's edges has unique keys on the other side, and
    a partition it fills is split at run time. Rounds end when the edges stop
    changing; each is written to the staging folder.

    Edges with a null end are ignored, self-edges only name their node, repeated
    edges count once, and an empty table gives an empty result.
    """
    known = staged(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "edges")
    nodes = known.select(F.col("a").alias("node")).union(known.select(F.col("b").alias("node"))).distinct()
    stars = staged(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = _digest(stars)
    while seen[0]:
        both = stars.union(stars.select("b", "a").toDF("a", "b"))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(lowest, "a").where("b > a AND b <> m").select(F.col("b").alias("x"), F.col("m").alias("y")).distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = staged(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    label = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
