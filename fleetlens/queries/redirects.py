"""Redirect and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators import graph, redirects as R
from fleetlens.queries.registry import query, table


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is an old page; titles repeat and some pages have a canonical."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("https://old.test/"), F.lower("c_mktsegment"), F.lit("/Item-"), k, F.lit("/?b=2&a=1")).alias("url"),
        F.concat(F.lit("Offer "), k % 400, F.lit("!")).alias("title"),
        F.concat(F.lit("item-"), k % 900).alias("slug"),
        F.when(k % 11 == 0, F.concat(F.lit("https://old.test/canon/"), k)).otherwise(F.lit("")).alias("canonical"),
    )


def destinations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(k % 3 == 0, F.concat(F.lit("https://new.test/"), F.lower("c_mktsegment"), F.lit("/item-"), k, F.lit("?a=1&b=2")))
        .when(k % 11 == 0, F.concat(F.lit("/canon/"), k)).otherwise(F.concat(F.lit("/shop/item-"), k)).alias("url"),
        F.concat(F.lit("item-"), k + 700).alias("slug"), F.concat(F.lit("Offer "), k + 100).alias("title"),
    )


def overrides(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").where("c_acctbal < -500").select(
        F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/item-"), k, F.lit("?a=1&b=2")).alias("key"),
        F.when(k % 2 == 0, "gone").otherwise("/special").alias("target"), F.lit(302).alias("status"),
    )


MATCH = """
src AS (SELECT c_custkey AS k, 'https://old.test/' || lower(c_mktsegment) || '/Item-' || c_custkey || '/?b=2&a=1' AS source,
   '/' || lower(c_mktsegment) || '/item-' || c_custkey || '?a=1&b=2' AS path, 'item-' || c_custkey % 900 AS slug,
   'offer ' || c_custkey % 400 AS title, CASE WHEN c_custkey % 11 = 0 THEN '/canon/' || c_custkey END AS canon, c_acctbal FROM customer),
dst AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'https://new.test/' || lower(c_mktsegment) || '/item-' || c_custkey || '?a=1&b=2'
     WHEN c_custkey % 11 = 0 THEN '/canon/' || c_custkey ELSE '/shop/item-' || c_custkey END AS url,
   'item-' || (c_custkey + 700) AS slug, 'offer ' || (c_custkey + 100) AS title FROM customer),
dk AS (SELECT url, replace(url, 'https://new.test', '') AS path, slug, title FROM dst),
cand AS (
  SELECT s.k, 100 AS score, 'exact_path' AS strategy, d.url, s.path AS mk FROM src s JOIN dk d ON s.path = d.path
  UNION ALL SELECT s.k, 90, 'canonical', d.url, s.canon FROM src s JOIN dk d ON s.canon = d.path
  UNION ALL SELECT s.k, 80, 'slug', d.url, s.slug FROM src s JOIN dk d ON s.slug = d.slug
  UNION ALL SELECT s.k, 70, 'title', d.url, s.title FROM src s JOIN dk d ON s.title = d.title),
best AS (SELECT k, max(score) AS score FROM cand GROUP BY k),
top AS (SELECT c.k, b.score, min(strategy) AS strategy, count(DISTINCT url) AS n, min(url) AS url, min(mk) AS mk FROM cand c JOIN best b ON c.k = b.k AND c.score = b.score GROUP BY 1, 2),
res AS (SELECT s.source,
  CASE WHEN s.c_acctbal < -500 THEN CASE WHEN s.k % 2 = 0 THEN '' ELSE '/special' END WHEN t.k IS NULL OR t.n > 1 THEN '' ELSE t.url END AS target,
  CASE WHEN s.c_acctbal < -500 THEN CASE WHEN s.k % 2 = 0 THEN 410 ELSE 302 END WHEN t.k IS NULL THEN 404 ELSE 301 END AS status,
  CASE WHEN s.c_acctbal < -500 THEN 'exact' WHEN t.k IS NULL THEN 'missing' WHEN t.n > 1 THEN 'ambiguous' WHEN t.score = 100 THEN 'exact' ELSE 'confident' END AS classification,
  CASE WHEN s.c_acctbal < -500 THEN 'override' WHEN t.k IS NULL THEN 'none' ELSE t.strategy END AS strategy,
  CASE WHEN s.c_acctbal < -500 THEN 0 ELSE coalesce(t.n, 0) END AS candidates,
  CASE WHEN s.c_acctbal < -500 THEN NULL ELSE t.mk END AS match_key FROM src s LEFT JOIN top t ON s.k = t.k)
"""


@query("redirect_match", f"WITH {MATCH} SELECT * FROM res")
def redirect_match(spark: SparkSession, d: str) -> DataFrame:
    return R.match(sources(spark, d), destinations(spark, d), overrides(spark, d))


@query("redirect_match_unicode", """
WITH c AS (SELECT c_custkey AS k FROM customer),
src AS (SELECT k, 'https://old.test/' || CASE WHEN k % 2 = 0 THEN 'Cafe' || chr(769) WHEN k % 3 = 0 THEN 'CAF%C3%89' ELSE 'Cafe' END || '/' || k || '/?q=' || k AS source FROM c),
dst AS (SELECT k, 'https://new.test/' || CASE WHEN k % 5 = 0 THEN 'cafe%CC%81' WHEN k % 7 = 0 THEN 'cafe' ELSE 'caf' || chr(233) END || '/' || k || '?q=' || k AS url,
   CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'cafe' ELSE 'caf' || chr(233) END AS word FROM c),
both_ AS (SELECT s.k, s.source, d.url, CASE WHEN s.k % 2 = 0 OR s.k % 3 = 0 THEN 'caf' || chr(233) ELSE 'cafe' END AS word, d.word AS to_word FROM src s JOIN dst d ON s.k = d.k)
SELECT source, CASE WHEN k % 13 = 0 THEN '/manual' ELSE url END AS target,
  CASE WHEN k % 13 = 0 THEN 'override' WHEN word = to_word THEN 'exact_path' ELSE 'slug' END AS strategy,
  CASE WHEN k % 13 = 0 THEN NULL WHEN word = to_word THEN '/' || word || '/' || k || '?q=' || k ELSE CAST(k AS VARCHAR) END AS match_key FROM both_""")
def redirect_match_unicode(spark: SparkSession, d: str) -> DataFrame:
    """Old and new paths that differ in how an accent is written: composed, decomposed or percent-encoded; what differs by more is found by slug."""
    k = F.col("c_custkey")
    customers = table(spark, d, "customer")
    accent = F.when(k % 2 == 0, "Cafe\u0301").when(k % 3 == 0, "CAF%C3%89").otherwise("Cafe")
    old = customers.select(F.concat(F.lit("https://old.test/"), accent, F.lit("/"), k, F.lit("/?q="), k).alias("url"))
    new = customers.select(F.concat(
        F.lit("https://new.test/"), F.when(k % 5 == 0, "cafe%CC%81").when(k % 7 == 0, "cafe").otherwise("caf\u00e9"), F.lit("/"), k, F.lit("?q="), k).alias("url"))
    word = F.when((k % 2 == 0) | (k % 3 == 0), "cafe\u0301").otherwise("cafe")
    manual = customers.where(k % 13 == 0).select(F.concat(F.lit("/"), word, F.lit("/"), k, F.lit("?q="), k).alias("key"), F.lit("/manual").alias("target"), F.lit(301).alias("status"))
    return R.match(old, new, manual).select("source", "target", "strategy", "match_key")


@query("redirect_stats", f"""
WITH {MATCH} SELECT count(*) AS total, count(*) FILTER (classification = 'exact') AS exact, count(*) FILTER (classification = 'confident') AS confident,
  count(*) FILTER (classification = 'ambiguous') AS ambiguous, count(*) FILTER (classification = 'missing') AS missing,
  count(*) FILTER (strategy = 'override') AS overrides FROM res""")
def redirect_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.match_stats(R.match(sources(spark, d), destinations(spark, d), overrides(spark, d)))


@query("redirect_candidates", f"""
WITH {MATCH} SELECT DISTINCT * FROM (SELECT 'exact_path' AS strategy, path AS key, url FROM dk UNION ALL SELECT 'slug', slug, url FROM dk UNION ALL SELECT 'title', title, url FROM dk)""")
def redirect_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.candidate_keys(destinations(spark, d))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A redirect map over customer keys: chains of up to ten hops, rings of seven, collisions, outside targets."""
    k = F.col("c_custkey")
    t = F.when(k % 100 < 7, k - k % 100 + (k + 1) % 100 % 7).when(k % 10 == 9, F.lit(-1)).otherwise(k + 1)
    base = table(spark, d, "customer").select(
        k.alias("seq"), F.concat(F.lit("/r/"), k).alias("source"),
        F.when(k % 53 == 0, F.concat(F.lit("https://out.test/"), k)).when(t == -1, F.lit("")).otherwise(F.concat(F.lit("/R/"), t, F.lit("/"))).alias("target"),
        F.when(k % 31 == 0, 410).otherwise(301).alias("status"),
        F.when(t == -1, "missing").otherwise("exact").alias("classification"), (k % 45 == 9).alias("required"),
    )
    again = base.where("seq % 17 = 0").select(
        (F.col("seq") + 10_000_000).alias("seq"), "source", F.lit("/hub").alias("target"), F.lit(301).alias("status"),
        F.lit("exact").alias("classification"), F.lit(False).alias("required"))
    return base.unionByName(again)


ENTRIES = """
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 100 < 7 THEN c_custkey - c_custkey % 100 + (c_custkey + 1) % 100 % 7
       WHEN c_custkey % 10 = 9 THEN -1 ELSE c_custkey + 1 END AS t FROM customer),
e AS (SELECT k AS seq, '/r/' || k AS source, CASE WHEN k % 53 = 0 THEN 'https://out.test/' || k WHEN t = -1 THEN '' ELSE '/r/' || t END AS target,
        CASE WHEN k % 31 = 0 THEN 410 ELSE 301 END AS status, CASE WHEN t = -1 THEN 'missing' ELSE 'exact' END AS classification, k % 45 = 9 AS required FROM b
      UNION ALL SELECT k + 10000000, '/r/' || k, '/hub', 301, 'exact', false FROM b WHERE k % 17 = 0),
edges AS (SELECT source AS src, arg_max(target, seq) AS dst FROM e
          WHERE target <> '' AND status <> 410 AND classification <> 'missing' AND NOT starts_with(target, 'https://') GROUP BY 1),
walk AS (
  SELECT src AS node, dst AS last, 1 AS hops, [src] AS seen, false AS looped FROM edges
  UNION ALL
  SELECT w.node, g.dst, w.hops + 1, list_append(w.seen, w.last), list_contains(w.seen, g.dst) OR g.dst = w.last
  FROM walk w JOIN edges g ON g.src = w.last WHERE NOT w.looped AND NOT list_contains(w.seen, w.last))
"""


@query("redirect_chains", f"""
WITH RECURSIVE {ENTRIES}
SELECT node AS start, last AS "end", CAST(hops AS BIGINT) AS hops FROM walk w
WHERE NOT looped AND hops >= 2 AND last NOT IN (SELECT src FROM edges) AND node NOT IN (SELECT dst FROM edges)""")
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.maximal_chains(R.redirect_edges(entries(spark, d)))


@query("redirect_loops", f"""
WITH RECURSIVE {ENTRIES},
ring AS (SELECT node, hops FROM walk WHERE last = node),
mem AS (SELECT w.node, w.last AS other, w.hops FROM walk w JOIN ring r ON w.node = r.node AND w.hops <= r.hops)
SELECT m.loop_id, CAST(coalesce(p.hops % r.hops, 0) AS BIGINT) AS position, m.node FROM (SELECT node, min(other) AS loop_id FROM mem GROUP BY node) m
JOIN ring r ON r.node = m.node LEFT JOIN mem p ON p.node = m.loop_id AND p.other = m.node""")
def redirect_loops(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(R.redirect_edges(entries(spark, d)))


@query("redirect_resolve", f"""
WITH RECURSIVE {ENTRIES},
t AS (
  SELECT src, dst AS cur, [src, dst] AS seen FROM edges WHERE src <> dst
  UNION ALL SELECT t.src, g.dst, list_append(t.seen, g.dst) FROM t JOIN edges g ON g.src = t.cur WHERE NOT list_contains(t.seen, g.dst))
SELECT src, arg_max(cur, len(seen)) AS target FROM t GROUP BY src HAVING src <> target""")
def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_ends(R.redirect_edges(entries(spark, d)))


@query("redirect_collisions", f"""
WITH RECURSIVE {ENTRIES}
SELECT source, count(DISTINCT (target, status)) AS n_targets, count(*) AS n_entries FROM e GROUP BY source HAVING n_targets > 1""")
def redirect_collisions(spark: SparkSession, d: str) -> DataFrame:
    from fleetlens.functions.url import match_path
    from fleetlens.operators.duplicates import collisions
    return collisions(entries(spark, d), match_path(F.col("source")), F.col("target"), F.col("status"))


@query("redirect_validation", f"""
WITH RECURSIVE {ENTRIES},
ring AS (SELECT node, hops FROM walk WHERE last = node),
loops AS (SELECT min(other) AS id, node, max(hops) AS n FROM (SELECT w.node, w.last AS other, r.hops FROM walk w JOIN ring r ON w.node = r.node AND w.hops <= r.hops) GROUP BY node)
SELECT rule, count(*) AS n, bool_or(critical) AS critical FROM (
  SELECT DISTINCT 'loop' AS rule, id AS subject, true AS critical FROM loops
  UNION ALL SELECT 'chain', node, false FROM walk WHERE NOT looped AND hops >= 2 AND last NOT IN (SELECT src FROM edges) AND node NOT IN (SELECT dst FROM edges)
  UNION ALL SELECT 'collision', source, true FROM e GROUP BY source HAVING count(DISTINCT (target, status)) > 1
  UNION ALL SELECT 'unresolved_required', source, true FROM e WHERE required AND (classification = 'missing' OR target = '') AND status <> 410
  UNION ALL SELECT 'external_target', source, false FROM e WHERE status <> 410 AND classification <> 'missing' AND starts_with(target, 'https://'))
GROUP BY rule""")
def redirect_validation(spark: SparkSession, d: str) -> DataFrame:
    found = R.validation_findings(entries(spark, d))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.bool_or("critical").alias("critical"))


def scene_edges(spark: SparkSession, d: str) -> DataFrame:
    """A graph over all customers: two choices per node, taken round the largest key, none where the key ends in 9."""
    k = F.col("c_custkey")
    customers = table(spark, d, "customer")
    n = customers.agg(F.max(k)).first()[0] or 1
    return customers.where(k % 10 != 9).select(k.alias("src"), F.explode(F.array((k * 2) % n, (k * 3 + 1) % n)).alias("dst"))


SCENES = """
g AS (SELECT c_custkey AS src, unnest([(c_custkey * 2) % n, (c_custkey * 3 + 1) % n]) AS dst FROM customer, (SELECT max(c_custkey) AS n FROM customer) WHERE c_custkey % 10 <> 9),
r AS (SELECT min(c_custkey) AS node, 0 AS hops FROM customer UNION SELECT g.dst, r.hops + 1 FROM r JOIN g ON g.src = r.node WHERE r.hops < 40),
reach AS (SELECT node, min(hops) AS hops FROM r GROUP BY node),
term AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 20 = 9)"""


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.min("c_custkey").alias("node"))


def _terminals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 20 = 9").select(F.col("c_custkey").alias("node"))


@query("reachability", f"""
WITH RECURSIVE {SCENES}
SELECT n.node, CAST(n.hops AS BIGINT) AS hops, min(p.node) AS via FROM reach n LEFT JOIN (
  SELECT reach.node, reach.hops, g.dst FROM reach JOIN g ON g.src = reach.node) p ON p.dst = n.node AND p.hops = n.hops - 1 GROUP BY 1, 2""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(scene_edges(spark, d), _roots(spark, d))


@query("dead_ends", f"""
WITH RECURSIVE {SCENES} SELECT node FROM reach WHERE node NOT IN (SELECT src FROM g) AND node NOT IN (SELECT node FROM term)""")
def dead_ends(spark: SparkSession, d: str) -> DataFrame:
    edges = scene_edges(spark, d)
    return graph.dead_ends(edges, graph.reachable(edges, _roots(spark, d)), _terminals(spark, d))


@query("cannot_finish", f"""
WITH RECURSIVE {SCENES},
back AS (SELECT node, 0 AS h FROM term UNION SELECT g.src, back.h + 1 FROM back JOIN g ON g.dst = back.node WHERE back.h < 40)
SELECT node FROM reach WHERE node NOT IN (SELECT node FROM back)""")
def cannot_finish(spark: SparkSession, d: str) -> DataFrame:
    edges = scene_edges(spark, d)
    return graph.cannot_finish(edges, graph.reachable(edges, _roots(spark, d)), _terminals(spark, d))


DEPS = """
dep AS (SELECT DISTINCT p AS src, k AS dst FROM (SELECT p_partkey AS k, unnest([p_partkey // 2, p_partkey // 3]) AS p FROM part
          UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 97 = 0) WHERE p <> k AND p IN (SELECT p_partkey FROM part)),
lv AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT dst FROM dep)
  UNION SELECT dep.dst, lv.level + 1 FROM lv JOIN dep ON dep.src = lv.node WHERE lv.level < 60),
bad AS (SELECT node FROM lv WHERE level >= 59 UNION SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT node FROM lv)),
blocked AS (SELECT node FROM bad UNION SELECT dep.dst FROM blocked JOIN dep ON dep.src = blocked.node)"""


@query("dependency_levels", f"""
WITH RECURSIVE {DEPS}
SELECT p.p_partkey AS node, CASE WHEN p.p_partkey IN (SELECT node FROM blocked) THEN NULL ELSE CAST(l.level AS BIGINT) END AS level
FROM part p LEFT JOIN (SELECT node, max(level) AS level FROM lv GROUP BY node) l ON l.node = p.p_partkey""")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    edges = part.select(k.alias("dst"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("src")).unionByName(
        part.where(k % 97 == 0).select(k.alias("dst"), (k + 1).alias("src")))
    return graph.dependency_levels(part.select(k.alias("node")), edges)


@query("reference_check", """
WITH u AS (SELECT DISTINCT l_suppkey * 3 AS name FROM lineitem), def AS (SELECT s_suppkey * 2 AS name FROM supplier)
SELECT name, 'undefined' AS problem FROM u WHERE name NOT IN (SELECT name FROM def)
UNION ALL SELECT name, 'unused' FROM def WHERE name NOT IN (SELECT name FROM u)""")
def reference_check(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("name"))
    return graph.reference_check(table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("name")), used)
