"""File-snapshot queries: orders are files of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators import disk, duplicates, intervals, tables as T
from fleetlens.queries.registry import query, table


def snapshot(spark: SparkSession, d: str, second: bool) -> DataFrame:
    """Orders as files below status/priority; the second snapshot drops, adds, grows and shrinks some."""
    k = F.col("o_orderkey")
    size = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    keep = k % 7 != 0 if second else k % 5 != 0
    if second:
        size = size + F.when(k % 11 == 0, 500).when(k % 11 == 1, -50).otherwise(0)
    files = table(spark, d, "orders").where(keep).select(
        k.alias("seq"), F.concat("o_orderstatus", F.lit("/"), F.substring("o_orderpriority", 1, 1), F.lit("/"), k).alias("path"),
        F.when(k % 101 == 0, "symlink").otherwise("file").alias("type"), size.alias("size"),
        (F.lit(1.0) * (k + F.when((k % 13 == 0) & F.lit(second), 1).otherwise(0))).alias("mtime"),
        F.when(k % 97 == 0, "denied").alias("error"))
    dirs = files.select(F.explode(F.array(F.lit("."), F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("path")).distinct().select(
        F.lit(0).cast("bigint").alias("seq"), "path", F.lit("dir").alias("type"), F.lit(4096).cast("bigint").alias("size"), F.lit(0.0).alias("mtime"),
        F.lit(None).cast("string").alias("error"))
    return disk.last_per_path(files.unionByName(dirs))


def _snap(n: int) -> str:
    keep, grow, touch = ("o_orderkey % 7 <> 0", "CASE o_orderkey % 11 WHEN 0 THEN 500 WHEN 1 THEN -50 ELSE 0 END", "CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END") if n == 2 else (
        "o_orderkey % 5 <> 0", "0", "0")
    return f"""
f{n} AS (SELECT o_orderstatus || '/' || left(o_orderpriority, 1) || '/' || o_orderkey AS path, o_orderstatus AS p1, o_orderstatus || '/' || left(o_orderpriority, 1) AS p2,
   CASE WHEN o_orderkey % 101 = 0 THEN 'symlink' ELSE 'file' END AS type, CAST(floor(o_totalprice * 100) AS BIGINT) + {grow} AS size, CAST(o_orderkey + {touch} AS DOUBLE) AS mtime, o_orderkey % 97 = 0 AS bad
   FROM orders WHERE {keep}),
d{n} AS (SELECT path, CAST(sum(CASE WHEN bad THEN 0 ELSE size END) AS BIGINT) AS size FROM (SELECT '.' AS path, size, bad FROM f{n} UNION ALL SELECT p1, size, bad FROM f{n} UNION ALL SELECT p2, size, bad FROM f{n}) GROUP BY path),
e{n} AS (SELECT path, type, size, mtime FROM f{n} UNION ALL SELECT path, 'dir', size, 0 FROM d{n})"""


SNAPS = f"""{_snap(1)}, {_snap(2)},
diff AS (SELECT coalesce(a.path, b.path) AS path,
   CASE WHEN coalesce(a.type, b.type) = 'dir' THEN 'dir' WHEN (a.path IS NULL OR b.path IS NULL) AND coalesce(a.type, b.type) = 'symlink' THEN 'symlink' ELSE 'file' END AS type,
   CASE WHEN a.path IS NULL THEN 'NEW' WHEN b.path IS NULL THEN 'DELETED' WHEN b.size > a.size THEN 'GROWN' WHEN b.size < a.size THEN 'SHRUNK'
     WHEN a.type <> 'dir' AND a.mtime <> b.mtime THEN 'MODIFIED_MTIME' ELSE 'UNCHANGED' END AS status,
   coalesce(a.size, 0) AS size_s1, coalesce(b.size, 0) AS size_s2, coalesce(b.size, 0) - coalesce(a.size, 0) AS change, a.mtime AS mtime_s1, b.mtime AS mtime_s2
   FROM e1 a FULL JOIN e2 b ON a.path = b.path WHERE coalesce(a.path, b.path) <> '.')"""


@query("snapshot_diff", f"WITH {SNAPS} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return disk.snapshot_diff(snapshot(spark, d, False), snapshot(spark, d, True))


@query("dir_rollup", f"WITH {_snap(1)} SELECT path, size FROM d1")
def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    return disk.cumulative_sizes(snapshot(spark, d, False))


@query("growth_top", f"WITH {SNAPS} SELECT path, change FROM diff WHERE status = 'GROWN' AND type <> 'dir' ORDER BY abs(change) DESC, path LIMIT 10")
def growth_top(spark: SparkSession, d: str) -> DataFrame:
    return disk.top_changes(snapshot_diff(spark, d), "GROWN", 10, dirs=False).select("path", "change")


@query("excluded_files", f"""
WITH {_snap(1)} SELECT count(*) AS n, count(*) FILTER (p1 = 'O' OR path LIKE 'F/1/%' OR regexp_matches(path, '/[^/]*7$')) AS excluded FROM f1""")
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    out = disk.excluded(F.col("path"), ["F/1"], ["O", "*7"])
    return snapshot(spark, d, False).where("type <> 'dir'").agg(F.count("*").alias("n"), F.count_if(out).alias("excluded"))


@query("interval_lookup", """
WITH b AS (SELECT CAST(p_partkey AS BIGINT) * 4 AS lo, CAST(p_partkey AS BIGINT) * 4 + 2 AS hi, 'band' || p_partkey AS label FROM part),
p AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem)
SELECT p.id, p.v, b.label FROM p LEFT JOIN b ON p.v // 4 * 4 = b.lo AND p.v BETWEEN b.lo AND b.hi""")
def interval_lookup(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor("l_extendedprice").cast("bigint").alias("v"))
    k = F.col("p_partkey")
    bands = table(spark, d, "part").select((k * 4).alias("lo"), (k * 4 + 2).alias("hi"), F.concat(F.lit("band"), k).alias("label"))
    return intervals.interval_lookup(points, bands, "v", "id", ["label"])


@query("interval_lookup_small", """
SELECT p_partkey AS id, p_retailprice AS v, n_name AS label FROM part LEFT JOIN nation ON p_retailprice BETWEEN 900 + n_nationkey * 50.0 AND 900 + n_nationkey * 50.0 + 30.0""")
def interval_lookup_small(spark: SparkSession, d: str) -> DataFrame:
    bands = table(spark, d, "nation").select((F.lit(900) + F.col("n_nationkey") * 50.0).alias("lo"), (F.lit(930) + F.col("n_nationkey") * 50.0).alias("hi"), F.col("n_name").alias("label"))
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return intervals.interval_lookup(points, bands, "v", "id", ["label"])


@query("row_count_drift", """
WITH c AS (SELECT 'orders' AS tbl, count(*) AS rows, count(*) FILTER (o_orderstatus <> 'F') AS prev FROM orders
  UNION ALL SELECT 'lineitem', count(*) FILTER (l_returnflag = 'R'), count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FILTER (value < 0), count(*) FROM events)
SELECT tbl, 'shrunk' AS rule FROM c WHERE rows > 0 AND (prev - rows) * 100.0 / prev > 20 UNION ALL SELECT tbl, 'empty' FROM c WHERE rows = 0
UNION ALL SELECT tbl, 'shrunk' FROM c WHERE rows = 0 UNION ALL SELECT 'audit', 'missing'""")
def row_count_drift(spark: SparkSession, d: str) -> DataFrame:
    orders, li, ev = (table(spark, d, n) for n in ("orders", "lineitem", "events"))
    now = T.row_counts({"orders": orders, "lineitem": li.where("l_returnflag = 'R'"), "events": ev.where("value < 0")})
    before = T.row_counts({"orders": orders.where("o_orderstatus <> 'F'"), "lineitem": li, "events": ev})
    return T.restore_findings(now, before, expected=["orders", "audit"], key_tables=["events"], max_shrink_pct=20).select("tbl", "rule")


@query("charset_drift", """
WITH t AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'wp_posts_' ELSE 'log_' END || s_suppkey AS tbl, s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'latin1' WHEN 1 THEN 'UTF8MB4' ELSE NULL END AS cs,
     CASE WHEN s_suppkey % 2 = 0 THEN 'utf8mb4_general_ci' ELSE 'utf8mb4_unicode_ci' END AS coll FROM supplier),
c AS (SELECT CASE WHEN s.s_suppkey % 4 = 0 THEN 'wp_posts_' ELSE 'log_' END || s.s_suppkey || '.c' || p_partkey AS obj, s.s_suppkey % 4 = 0 AS uc,
     CASE p_partkey % 5 WHEN 0 THEN 'utf8' WHEN 1 THEN NULL ELSE 'utf8mb4' END AS cs, CASE WHEN p_partkey % 7 = 0 THEN 'utf8mb4_bin' ELSE 'utf8mb4_unicode_ci' END AS coll
   FROM part JOIN supplier s ON s.s_suppkey = p_partkey % (SELECT count(*) FROM supplier) + 1 WHERE p_partkey % 3 <> 0)
SELECT 'table' AS level, tbl AS object, 'charset' AS type, 'medium' AS severity FROM t WHERE cs = 'latin1'
UNION ALL SELECT 'table', tbl, 'collation', 'low' FROM t WHERE cs IS DISTINCT FROM 'latin1' AND coll <> 'utf8mb4_unicode_ci'
UNION ALL SELECT 'column', obj, 'charset', CASE WHEN uc THEN 'high' ELSE 'medium' END FROM c WHERE cs = 'utf8'
UNION ALL SELECT 'column', obj, 'collation', 'low' FROM c WHERE cs IS DISTINCT FROM 'utf8' AND coll <> 'utf8mb4_unicode_ci'""")
def charset_drift(spark: SparkSession, d: str) -> DataFrame:
    tables_, columns = catalog(spark, d)
    return T.charset_findings(tables_, columns).select("level", "object", "type", "severity")


def catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    supplier = table(spark, d, "supplier")
    name = F.concat(F.when(k % 4 == 0, "wp_posts_").otherwise("log_"), k)
    tables_ = supplier.select(name.alias("tbl"), F.when(k % 3 == 0, "latin1").when(k % 3 == 1, "UTF8MB4").alias("charset"),
                              F.when(k % 2 == 0, "utf8mb4_general_ci").otherwise("utf8mb4_unicode_ci").alias("collation"),
                              F.when(k % 5 == 0, "Compact").otherwise("Dynamic").alias("row_format"))
    p = F.col("p_partkey")
    n = supplier.agg(F.count("*")).scalar()
    columns = table(spark, d, "part").select(
        (p % n + 1).alias("s_suppkey"), F.concat(F.lit("c"), p).alias("col"), F.when(p % 3 == 0, "int").otherwise("varchar").alias("data_type"),
        F.when(p % 5 == 0, "utf8").when(p % 5 > 1, "utf8mb4").alias("charset"), F.when(p % 7 == 0, "utf8mb4_bin").otherwise("utf8mb4_unicode_ci").alias("collation"),
        (p % 300 + 100).alias("length")).join(supplier.select("s_suppkey", name.alias("tbl")), "s_suppkey").drop("s_suppkey")
    return tables_, columns


@query("index_overflow", """
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'wp_posts_' ELSE 'log_' END || s_suppkey AS tbl, s_suppkey % 3 = 0 AS bad, s_suppkey % 5 = 0 AS compact FROM supplier),
c AS (SELECT s.*, p_partkey AS p, 'c' || p_partkey AS col, p_partkey % 300 + 100 AS length, p_partkey % 5 = 0 AS cbad FROM part JOIN s ON s.k = p_partkey % (SELECT count(*) FROM supplier) + 1),
conv AS (SELECT tbl FROM s WHERE bad UNION SELECT tbl FROM c WHERE cbad AND p % 3 <> 0)
SELECT tbl, 'ix_' || col AS index_name, col, CAST((CASE WHEN p % 10 = 1 THEN 200 ELSE length END) * 4 AS BIGINT) AS bytes, CASE WHEN compact THEN 767 ELSE 3072 END AS byte_limit
FROM c WHERE p % 3 <> 0 AND tbl IN (SELECT tbl FROM conv) AND (CASE WHEN p % 10 = 1 THEN 200 ELSE length END) * 4 > CASE WHEN compact THEN 767 ELSE 3072 END""")
def index_overflow(spark: SparkSession, d: str) -> DataFrame:
    tables_, columns = catalog(spark, d)
    number = F.substring("col", 2, 20).cast("bigint")
    parts = columns.select("tbl", F.concat(F.lit("ix_"), "col").alias("index_name"), "col", F.when(number % 10 == 1, 200).alias("sub_part"))
    return T.index_overflows(tables_, columns, parts)


@query("findings_by_table", """
SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'wp_posts_' ELSE 'log_' END || s_suppkey AS tbl, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS charset, CASE WHEN s_suppkey % 3 <> 0 THEN 1 ELSE 0 END AS collation
FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""")
def findings_by_table(spark: SparkSession, d: str) -> DataFrame:
    tables_, columns = catalog(spark, d)
    return T.findings_by_table(T.charset_findings(tables_, columns).where("level = 'table'")).select(
        "tbl", F.col("charset").cast("int").alias("charset"), F.col("collation").cast("int").alias("collation"))


def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys between the catalog's tables: every tenth third-numbered table starts a ring of three with a tail and a diamond behind it."""
    k = F.col("s_suppkey")
    supplier = table(spark, d, "supplier")
    m = F.floor(k / 3).cast("bigint")
    steps = F.when(k % 3 != 0, F.when(k % 5 == 1, F.array(F.lit(-1)))).otherwise(
        F.when(m % 10 == 1, F.array(F.lit(3), F.lit(-6))).when(m % 10 == 2, F.array(F.lit(3))).when(m % 10 == 3, F.array(F.lit(-6)))
        .when(m % 10 == 6, F.array(F.lit(-3), F.lit(-15))).when(m % 20 == 17, F.array(F.lit(-33))).when(m % 10 == 9, F.array(F.lit(0)))
        .when(m % 10 == 0, F.array(F.lit(-6), F.lit(-9))).when(m % 10 != 7, F.array(F.lit(-3))))
    names = supplier.select(k.alias("ref"), F.concat(F.when(k % 4 == 0, "wp_posts_").otherwise("log_"), k).alias("ref_tbl"))
    keys = supplier.select(F.concat(F.when(k % 4 == 0, "wp_posts_").otherwise("log_"), k).alias("tbl"), F.explode(F.transform(steps, lambda s: k + s)).alias("ref"))
    return keys.join(names, "ref").select("tbl", "ref_tbl")


@query("conversion_plan", """
WITH RECURSIVE s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_suppkey // 3 AS m, CASE WHEN s_suppkey % 4 = 0 THEN 'wp_posts_' ELSE 'log_' END || s_suppkey AS tbl FROM supplier),
conv AS (SELECT k, m, tbl FROM s WHERE k % 3 = 0 OR k IN (SELECT p_partkey % (SELECT count(*) FROM supplier) + 1 FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 <> 0)),
ref AS (SELECT k AS child, k + unnest(CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 5 = 1 THEN [-1] ELSE [] END WHEN m % 10 = 1 THEN [3, -6] WHEN m % 10 = 2 THEN [3] WHEN m % 10 = 3 THEN [-6]
    WHEN m % 10 = 6 THEN [-3, -15] WHEN m % 20 = 17 THEN [-33] WHEN m % 10 = 9 THEN [0] WHEN m % 10 = 0 THEN [-6, -9] WHEN m % 10 = 7 THEN [] ELSE [-3] END) AS parent FROM s),
e AS (SELECT DISTINCT r.parent AS src, r.child AS dst FROM ref r JOIN conv a ON a.k = r.parent JOIN conv b ON b.k = r.child WHERE r.parent <> r.child),
reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b),
part_of AS (SELECT c.k, c.tbl, coalesce(min(least(c.tbl, t.tbl)), c.tbl) AS unit FROM conv c LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) z ON z.a = c.k
    LEFT JOIN conv t ON t.k = z.b GROUP BY c.k, c.tbl),
links AS (SELECT DISTINCT a.unit AS src, b.unit AS dst FROM e JOIN part_of a ON a.k = e.src JOIN part_of b ON b.k = e.dst WHERE a.unit <> b.unit),
deep AS (SELECT unit, 0 AS level FROM part_of UNION SELECT l.dst, d.level + 1 FROM deep d JOIN links l ON l.src = d.unit),
top AS (SELECT unit, max(level) AS step FROM deep GROUP BY unit)
SELECT CAST(t.step AS BIGINT) AS step, p.unit, count(*) OVER (PARTITION BY p.unit) AS n_tables, p.tbl, 'ALTER TABLE `' || p.tbl || '` CONVERT TO CHARACTER SET utf8mb4 COLLATE utf8mb4_unicode_ci' AS statement
FROM part_of p JOIN top t ON t.unit = p.unit""")
def conversion_plan(spark: SparkSession, d: str) -> DataFrame:
    return T.conversion_plan(*catalog(spark, d), foreign_keys(spark, d))


@query("schedule_overlap", """
SELECT schedule, count(*) AS n_jobs, min(c_name) AS first_job FROM (
  SELECT c_name, CASE c_custkey % 6 WHEN 0 THEN '0 0 * * *' WHEN 1 THEN '0 0 * * *' WHEN 2 THEN '0 * * * *' WHEN 3 THEN '' ELSE c_custkey % 60 || ' ' || c_nationkey || ' * * *' END AS schedule FROM customer)
WHERE schedule <> '' GROUP BY 1 HAVING count(*) > 1""")
def schedule_overlap(spark: SparkSession, d: str) -> DataFrame:
    from fleetlens.plans.schedule import normal_schedule
    k = F.col("c_custkey")
    raw = F.when(k % 6 == 0, "@Daily").when(k % 6 == 1, " midnight").when(k % 6 == 2, "hourly").when(k % 6 == 3, "").otherwise(
        F.concat(k % 60, F.lit("  "), "c_nationkey", F.lit(" * * *")))
    return duplicates.same_schedule(table(spark, d, "customer").select(F.col("c_name").alias("job"), raw.alias("raw")), normal_schedule(F.col("raw")))
