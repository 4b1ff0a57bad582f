"""Strongly connected components of an edge table, and the order of a graph whose cycles count as one step.

What lies on no cycle is peeled off from both sides first. In the core that is
left every node takes the least label among the nodes that reach it; labels are
hashes, so a round finds about as many components as a random order would and
the number of rounds grows with the logarithm of the core, not with its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.graph import dependency_levels, reachable
from fleetlens.operators.skew import hot_keys, lookup
from fleetlens.session import staged


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among `nodes` (node, distinct)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def least_labels(edges: DataFrame, labels: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(node, label): the least label of the nodes from which an edge path leads to `node`, its own included.

    Only nodes whose label fell in a round send it on in the next one. `edges` is
    joined in every round, so hand it in staged; `hot` are its hot sources, if known.
    """
    hot = staged(hot_keys(edges, "src"), "hot") if hot is None else hot
    state = staged(labels.select("node", "label", F.lit(True).alias("fell")), "labels")
    while state.where("fell").limit(1).count():
        senders = state.where("fell").select(F.col("node").alias("src"), "label")
        heard = lookup(edges, senders, "src", ["dst"], how="inner", hot=hot).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        state = staged(state.join(heard, "node", "left").select(
            "node", F.least("label", F.coalesce("heard", "label")).alias("label"),
            F.coalesce(F.col("heard") < F.col("label"), F.lit(False)).alias("fell")), "labels")
    return state.select("node", "label")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that reaches `node` and is reached from it, `node` itself if there is no other.

    Edges (src, dst) with an end that is null or not in `nodes`, repeated edges and
    edges of a node to itself make no difference; null nodes are left out.
    """
    rest = staged(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    links = staged(_between(edges.where("src <> dst").select("src", "dst").distinct(), rest), "links")
    alone = []
    for way in (links, _turned(links)):
        levels = staged(dependency_levels(rest, way), "levels")
        alone.append(levels.where("level IS NOT NULL").select("node", F.col("node").alias("component")))
        rest = levels.where("level IS NULL").select("node")
    found = alone[0].unionByName(alone[1])
    while rest.limit(1).count():
        core = staged(_between(links, rest), "core")
        hot = staged(hot_keys(core, "src"), "hot")
        label = least_labels(core, rest.select("node", F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("root")).alias("label")), hot)
        at_source = label.select(F.col("node").alias("src"), F.col("label").alias("from"))
        at_target = label.select(F.col("node").alias("dst"), F.col("label").alias("to"))
        same = lookup(lookup(core, at_source, "src", ["dst"], hot=hot), at_target, "dst", ["src"], base=core).where(F.col("from") == F.col("to"))
        # A label's own node is reached back by just the members of its component.
        home = reachable(_turned(same), label.where("label.root = node").select("node")).select("node")
        members = staged(label.join(home, "node", "left_semi"), "members")
        names = members.groupBy("label").agg(F.min("node").alias("component"))
        found = found.unionByName(staged(members.join(names, "label").select("node", "component"), "component"))
        rest = staged(rest.join(members, "node", "left_anti"), "rest")
    return found


def condensed_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level) for every node: level 0 without parents outside its component, else one above the highest of these.

    Edges run parent (src) -> child (dst). A component is one step, so cycles have levels too.
    """
    part = staged(strong_components(nodes, edges), "parts")
    ends = edges.join(part.select(F.col("node").alias("src"), F.col("component").alias("above")), "src").join(
        part.select(F.col("node").alias("dst"), F.col("component").alias("below")), "dst")
    between = ends.where("above <> below").select(F.col("above").alias("src"), F.col("below").alias("dst")).distinct()
    steps = dependency_levels(part.select(F.col("component").alias("node")), between)
    return part.join(steps.select(F.col("node").alias("component"), "level"), "component").select("node", "component", "level")
