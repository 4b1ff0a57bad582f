"""Graph operators on edge tables: functional graphs by pointer doubling, others by frontier rounds.

Every round is staged to the shared folder, so plans stay short and a lost
executor never replays earlier rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.skew import hot_keys, lookup
from fleetlens.session import staged


def last_edge(entries: DataFrame, src: str, dst: str, seq: str) -> DataFrame:
    """One edge per source: the last one by `seq`."""
    return entries.groupBy(F.col(src).alias("src")).agg(F.max_by(dst, seq).alias("dst"))


def walk_ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ended, endless) nodes of a functional graph.

    ended: (node, last, hops), the end of the walk that leaves `node`.
    endless: (node, last) where `last` lies on a cycle; `last` runs over exactly
    the cycle nodes. Each round doubles the step. The set of nodes a step can
    reach shrinks until it holds cycle nodes only, and has then stopped shrinking.
    """
    state = staged(edges.select(
        F.col("src").alias("node"), F.col("dst").alias("last"), F.lit(1).cast("bigint").alias("hops"),
        F.col("dst").alias("came"), F.lit(True).alias("open")), "walk")
    targets, n_open = -1, state.count()
    while True:
        live = state.where("open")
        table = state.select(F.col("node").alias("last"), F.col("last").alias("_to"), F.col("hops").alias("_more"))
        stepped = lookup(live, table, "last", ["node"], base=live).select(
            "node", F.coalesce("_to", "last").alias("last"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
            F.col("last").alias("came"), F.col("_to").isNotNull().alias("open"))
        state = staged(stepped.unionByName(state.where("not open")), "walk")
        # `came` is the node before the step, which is known to go on.
        n_open, reach = state.where("open").agg(F.count("*"), F.count_distinct("came")).first()
        if n_open == 0 or reach == targets:
            return state.where("not open").select("node", "last", "hops"), state.where("open").select("node", "last")
        targets = reach


Walk = tuple[DataFrame, DataFrame]


def cycles(edges: DataFrame, walk: Walk | None = None) -> DataFrame:
    """(loop_id, position, node) of every cycle; loop_id is the smallest member, at position 0."""
    edges = staged(edges, "edges")
    _, endless = walk or walk_ends(edges)
    ring = endless.select(F.col("last").alias("node")).distinct()
    step = staged(edges.join(ring, edges.src == ring.node).select("src", "dst"), "ring")
    labels = staged(step.select(F.col("src").alias("node"), F.col("dst").alias("far"),
                                F.least("src", "dst").alias("label")), "labels")
    while True:
        ahead = labels.select(F.col("node").alias("far"), F.col("far").alias("far2"), F.col("label").alias("label2"))
        nxt = staged(labels.join(ahead, "far").select(
            "node", F.col("far2").alias("far"), F.least("label", "label2").alias("label"),
            (F.col("label2") < F.col("label")).alias("_moved")), "labels")
        moved = nxt.where("_moved").limit(1).count()
        labels = nxt.drop("_moved")
        if not moved:
            break
    label = labels.select("node", F.col("label").alias("loop_id"))
    # Walking the ring backwards from a node ends at its label: the hops are the position.
    back = step.join(label, step.dst == label.node).where(F.col("dst") != F.col("loop_id")).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"))
    spots, _ = walk_ends(back)
    return label.join(spots.select("node", F.col("hops").alias("position")), "node", "left").select(
        "loop_id", F.coalesce("position", F.lit(0).cast("bigint")).alias("position"), "node")


def chain_ends(edges: DataFrame) -> DataFrame:
    """src -> final target of its walk; a walk into a cycle stops at the node before the first repeat.

    Self-edges and sources that end at themselves are left out.
    """
    proper = staged(edges.where(F.col("src") != F.col("dst")), "proper")
    selfish = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    ended, endless = walk_ends(proper)
    plain = ended.select(F.col("node").alias("src"), F.col("last").alias("target"))
    if endless.limit(1).count() == 0:
        return plain.where("src <> target")
    ring = staged(endless.select(F.col("last").alias("node")).distinct(), "ring")
    # Outside the ring, walks end at the first ring node: their entry.
    tails = proper.join(ring, proper.src == ring.node, "left_anti")
    entries, _ = walk_ends(tails)
    entered = entries.join(ring, entries["last"] == ring.node, "left_semi").select(
        F.col("node").alias("src"), F.col("last").alias("entry"))
    on_ring = ring.select(F.col("node").alias("src"), F.col("node").alias("entry"))
    before = proper.join(ring, proper.src == ring.node, "left_semi").select(
        F.col("dst").alias("entry"), F.col("src").alias("target"))
    looped = lookup(entered.unionByName(on_ring), before, "entry", ["src"], how="inner").select("src", "target")
    outside = plain.join(ring, plain.src == ring.node, "left_anti").join(
        entered.select("src"), "src", "left_anti")
    return outside.unionByName(looped).where("src <> target").join(
        selfish, F.col("src") == F.col("node"), "left_anti")


def maximal_chains(edges: DataFrame, walk: Walk | None = None) -> DataFrame:
    """(start, end, hops) of the walks of two hops or more that start where nothing points and do not loop."""
    ended, _ = walk or walk_ends(edges)
    targets = edges.select(F.col("dst").alias("node")).distinct()
    return ended.join(targets, "node", "left_anti").where("hops >= 2").select(
        F.col("node").alias("start"), F.col("last").alias("end"), "hops")


def _stepper(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from a frontier (node) to the edges that leave it.

    The edges are staged and their hot sources found once, before the rounds.
    """
    table = staged(edges.select("src", "dst"), "edges")
    hot = staged(hot_keys(table, "src"), "hot")

    def step(frontier: DataFrame) -> DataFrame:
        here = frontier.select(F.col("node").alias("src"), F.lit(True).alias("_here"))
        return lookup(table, here, "src", ["dst"], how="inner", hot=hot).select("src", "dst")

    return step


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, hops, via): shortest hop count from any root and the smallest predecessor that gives it.

    Following `via` back to a root spells one shortest path.
    """
    step_from = _stepper(edges)
    seen = staged(roots.select("node").distinct().select(
        "node", F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("via")), "seen")
    frontier, rounds = seen, 0
    while frontier.limit(1).count():
        rounds += 1
        found = step_from(frontier).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        frontier = staged(found.join(seen.select("node"), "node", "left_anti").select(
            "node", F.lit(rounds).cast("bigint").alias("hops"), "via"), "frontier")
        seen = seen.unionByName(frontier)
        if rounds % 8 == 0:
            seen = staged(seen, "seen")
    return seen


def dead_ends(edges: DataFrame, reached: DataFrame, terminals: DataFrame) -> DataFrame:
    """Reached nodes without an out-edge that are not terminal."""
    return reached.select("node").join(terminals.select("node"), "node", "left_anti").join(
        edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def cannot_finish(edges: DataFrame, reached: DataFrame, terminals: DataFrame) -> DataFrame:
    """Reached nodes from which no terminal can be reached."""
    backwards = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached.select("node").join(reachable(backwards, terminals).select("node"), "node", "left_anti")


def dependency_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without parents, else one more than the highest parent; null inside or behind a cycle.

    `edges` run parent (src) -> child (dst). Each round settles the nodes all of
    whose parents are settled, comparing counts instead of parent lists.
    """
    known = nodes.select("node").distinct()
    proper = staged(edges.where("src <> dst").select("src", "dst").distinct()
                    .join(known.select(F.col("node").alias("src")), "src", "left_semi")
                    .join(known.select(F.col("node").alias("dst")), "dst", "left_semi"), "deps")
    open_counts = staged(proper.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open")), "open")
    step_from = _stepper(proper)
    level = 0
    settled = staged(known.join(open_counts, "node", "left_anti").select(
        "node", F.lit(0).cast("bigint").alias("level")), "level")
    frontier = settled
    while frontier.limit(1).count():
        level += 1
        freed = step_from(frontier).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("freed"))
        open_counts = staged(open_counts.join(freed, "node", "left").select(
            "node", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")).where("open >= 0"), "open")
        frontier = staged(open_counts.where("open = 0").select("node", F.lit(level).cast("bigint").alias("level")), "level")
        open_counts = open_counts.where("open > 0")
        settled = settled.unionByName(frontier)
    return known.join(settled, "node", "left")


def reference_check(defined: DataFrame, used: DataFrame) -> DataFrame:
    """Names used but never defined (undefined) and defined but never used (unused)."""
    d, u = defined.select("name").distinct(), used.select("name").distinct()
    missing = u.join(d, "name", "left_anti").select("name", F.lit("undefined").alias("problem"))
    idle = d.join(u, "name", "left_anti").select("name", F.lit("unused").alias("problem"))
    return missing.unionByName(idle)
