"""Strongly connected components and conversion plans against plain searches."""

import random

from fleetlens.operators import strong, tables as T

EDGE = "src bigint, dst bigint"


def brute(nodes, edges):
    after = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}

    def reached(n):
        seen, todo = {n}, [n]
        while todo:
            for m in after[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    reach = {n: reached(n) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def found(spark, nodes, edges):
    rows = strong.strong_components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, EDGE)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_shapes(spark):
    ring = [(10, 11), (11, 12), (12, 10)]
    edges = ring + [(12, 20), (20, 21), (21, 20), (21, 30), (30, 30), (5, 10), (10, 11), (99, 1), (1, 99), (None, 1), (40, 41)]
    nodes = {1, 5, 10, 11, 12, 20, 21, 30, 40, 41, 50}
    assert found(spark, sorted(nodes) + [50, None], edges) == brute(nodes, [e for e in edges if None not in e and 99 not in e])
    assert found(spark, [], []) == {}


def test_random_graphs(spark):
    rng = random.Random(1)
    edges = [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for g, n in enumerate((4, 8, 12, 16, 16, 24)) for _ in range(n * (4 + g) // 4)]
    nodes = {n for e in edges for n in e}
    assert found(spark, nodes, edges) == brute(nodes, edges)


def test_plan_and_script(spark):
    tables = spark.createDataFrame([(t, "latin1", "x", "Dynamic") for t in "abcdefg"] + [("ok", "utf8mb4", "x", "Dynamic"), ("we`ird", "latin1", "x", "Dynamic")],
                                   "tbl string, charset string, collation string, row_format string")
    columns = spark.createDataFrame([("ok", "c", "varchar", None, None, 10)], "tbl string, col string, data_type string, charset string, collation string, length int")
    keys = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "g"), ("d", "a"), ("d", "ok"), ("ok", "e"), ("e", "d"), ("f", "f"), ("f", "gone"), ("f", None)],
                                 "tbl string, ref_tbl string")
    plan = T.conversion_plan(tables, columns, keys)
    assert sorted((r.step, r.unit, r.n_tables, r.tbl) for r in plan.collect()) == [
        (0, "f", 1, "f"), (0, "g", 1, "g"), (0, "we`ird", 1, "we`ird"), (1, "a", 3, "a"), (1, "a", 3, "b"), (1, "a", 3, "c"), (2, "d", 1, "d"), (3, "e", 1, "e")]
    bases = spark.createDataFrame([("shop", "latin1"), ("blog", "utf8mb4"), ("none", None)], "name string, charset string")
    script = [r.statement for r in T.conversion_script(plan, bases).orderBy("phase", "step", "unit", "tbl").collect()]
    assert script[0] == "SET FOREIGN_KEY_CHECKS=0" and script[-1] == "SET FOREIGN_KEY_CHECKS=1"
    assert script[1] == "ALTER DATABASE `shop` CHARACTER SET utf8mb4 COLLATE utf8mb4_unicode_ci" and len(script) == 11
    assert script[4] == "ALTER TABLE `we``ird` CONVERT TO CHARACTER SET utf8mb4 COLLATE utf8mb4_unicode_ci"
    assert T.conversion_script(plan.limit(0)).count() == 0
