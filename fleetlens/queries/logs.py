"""Statement-log queries: events stand in for a slow-query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions import sqltext
from fleetlens.operators import statements
from fleetlens.queries.registry import query, table
from fleetlens.session import staged


def statement_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sql = F.concat(
        F.lit("SELECT *  FROM t_"), F.col("event_type"), F.lit(" WHERE user_id = "), F.col("user_id"),
        F.lit(" AND v > "), F.col("value").cast("string"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" AND k IN ("), F.col("event_id"), F.lit(", 7,8) ORDER BY ts")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit(" AND name='u"), F.col("user_id"), F.lit("';")))
        .otherwise(F.lit(" /* hot */ LIMIT 10")),
    )
    return e.select(
        F.col("event_id").alias("seq"), sql.alias("sql"), F.col("value").alias("query_ms"),
        (F.col("event_id") % 4).alias("rows_sent"), (F.col("event_id") % 1000).alias("rows_examined"),
    )


LOG_SQL = """
log AS (
  SELECT event_id AS seq, value AS query_ms, event_id % 4 AS rows_sent, event_id % 1000 AS rows_examined,
         'SELECT *  FROM t_' || event_type || ' WHERE user_id = ' || user_id || ' AND v > ' || CAST(value AS VARCHAR) ||
         CASE event_id % 3 WHEN 0 THEN ' AND k IN (' || event_id || ', 7,8) ORDER BY ts'
                           WHEN 1 THEN ' AND name=''u' || user_id || ''';'
                           ELSE ' /* hot */ LIMIT 10' END AS sql
  FROM events),
norm0 AS (
  SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(sql, '/\\*.*?\\*/', ' ', 'g'), '''[^'']*''', '?', 'g'),
                  '(^|[^\\w$.])-?\\d+(?:\\.\\d+)?', '\\1?', 'g')) AS s0 FROM log),
norm1 AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0, '\\s*(<=|>=|=|<|>)\\s*', ' \\1 ', 'g'),
         '\\s*,\\s*', ', ', 'g'), '\\bin\\s*\\(\\s*\\?(?:,\\s*\\?)*\\s*\\)', 'in (?)', 'g'), '\\s+', ' ', 'g')) AS s1 FROM norm0),
norm AS (SELECT *, regexp_replace(s1, ';+\\s*$', '') AS normalized FROM norm1),
dig AS (
  SELECT substr(sha1(normalized), 1, 12) AS digest, min(normalized) AS normalized, arg_min(sql, seq) AS sample,
         count(*) AS count, CAST(sum(CAST(query_ms AS DECIMAL(38,6))) AS DOUBLE) AS total,
         quantile_disc(query_ms, 0.95) AS p95, sum(rows_examined) AS rows_examined, sum(rows_sent) AS rows_sent
  FROM norm GROUP BY 1),
digests AS (
  SELECT digest, normalized, sample, count, floor(total * 10 + 0.5) / 10 AS total_ms,
         floor(total / count * 10 + 0.5) / 10 AS mean_ms, floor(p95 * 10 + 0.5) / 10 AS p95_ms,
         CAST(rows_examined AS BIGINT) AS rows_examined, CAST(rows_sent AS BIGINT) AS rows_sent,
         CAST(floor(rows_examined / greatest(rows_sent, 1) + 0.5) AS BIGINT) AS examine_ratio
  FROM dig),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_ms DESC, digest) AS rank FROM digests)
"""


@query("statement_digest", f"WITH {LOG_SQL} SELECT * FROM ranked")
def statement_digest(spark: SparkSession, d: str) -> DataFrame:
    return statements.statement_digests(statement_log(spark, d))


@query("slow_top_n", f"WITH {LOG_SQL} SELECT rank, digest, total_ms FROM ranked WHERE rank <= 5")
def slow_top_n(spark: SparkSession, d: str) -> DataFrame:
    return statements.statement_digests(statement_log(spark, d)).where("rank <= 5").select("rank", "digest", "total_ms")


@query("index_candidates", f"""
WITH {LOG_SQL}
SELECT digest, tbl, cols,
       'ALTER TABLE `' || tbl || '` ADD INDEX `' || substr('idx_' || tbl || '_' || replace(cols, ',', '_'), 1, 60) ||
       '` (`' || replace(cols, ',', '`, `') || '`);' AS ddl
FROM (SELECT DISTINCT digest, regexp_extract(normalized, 'from (t_[a-z]+)', 1) AS tbl,
             CASE WHEN normalized LIKE '%k in%' THEN 'user_id,k,v'
                  WHEN normalized LIKE '%name =%' THEN 'user_id,name,v' ELSE 'user_id,v' END AS cols
      FROM digests)""")
def index_candidates(spark: SparkSession, d: str) -> DataFrame:
    log = statement_log(spark, d).select(sqltext.normalize(F.col("sql")).alias("normalized")).distinct()
    digests = log.withColumn("digest", sqltext.digest_id(F.col("normalized")))
    return statements.index_candidates(digests).withColumn("cols", F.array_join("cols", ","))


def existing_indexes(spark: SparkSession, d: str) -> DataFrame:
    """One index per event type; errors and views are indexed on (user_id, v, ts), others on (ts)."""
    types = table(spark, d, "events").select("event_type").distinct()
    return types.select(
        F.concat(F.lit("T_"), F.upper("event_type")).alias("tbl"),
        F.when(F.col("event_type").isin("error", "view"), F.array(F.lit("USER_ID"), F.lit("v"), F.lit("ts")))
        .otherwise(F.array(F.lit("ts"))).alias("columns"),
    )


@query("index_coverage", f"""
WITH {LOG_SQL}
SELECT DISTINCT digest, regexp_extract(normalized, 'from (t_[a-z]+)', 1) AS tbl
FROM digests
WHERE normalized NOT LIKE '%k in%' AND normalized NOT LIKE '%name =%'
  AND (normalized LIKE '%t_error%' OR normalized LIKE '%t_view%')""")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    log = statement_log(spark, d).select(sqltext.normalize(F.col("sql")).alias("normalized")).distinct()
    digests = log.withColumn("digest", sqltext.digest_id(F.col("normalized")))
    cands = statements.index_candidates(digests)
    return statements.covered_candidates(cands, existing_indexes(spark, d)).select("digest", "tbl")


@query("statement_diagnosis", f"""
WITH {LOG_SQL},
c AS (SELECT digest, examine_ratio, rows_examined, normalized LIKE '%name =%' AS scan, normalized LIKE '%order by%' AS sorts,
             regexp_extract(normalized, 'from (t_[a-z]+)', 1) AS tbl,
             CASE WHEN normalized LIKE '%k in%' THEN 'user_id,k,v' WHEN normalized LIKE '%name =%' THEN 'user_id,name,v' ELSE 'user_id,v' END AS cols,
             normalized NOT LIKE '%k in%' AND normalized NOT LIKE '%name =%' AND (normalized LIKE '%t_error%' OR normalized LIKE '%t_view%') AS covered
      FROM digests)
SELECT digest, array_to_string(list_filter([
         CASE WHEN scan THEN 'full table scan on `' || tbl || '`' WHEN sorts THEN 'filesort on `' || tbl || '`' END,
         CASE WHEN examine_ratio >= 100 AND rows_examined > 0 THEN 'reads ' || examine_ratio || ' rows for each row sent' END], lambda x: x IS NOT NULL), '; ') AS flags,
       FALSE AS parameterized, covered, CASE WHEN NOT covered THEN tbl END AS tbl, CASE WHEN NOT covered THEN cols END AS cols,
       CASE WHEN NOT covered THEN CASE WHEN scan THEN 'high' ELSE 'to check' END END AS confidence
FROM c""")
def statement_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    digests = staged(statements.statement_digests(statement_log(spark, d)), "digests")
    text = F.col("normalized")
    explain = digests.select(
        "digest", F.lit(1).alias("seq"), F.when(text.contains("name ="), "ALL").otherwise("ref").alias("type"), F.lit("k").alias("key"),
        F.when(text.contains("order by"), "Using where; Using filesort").alias("extra"), F.regexp_extract(text, "from (t_[a-z]+)", 1).alias("tbl"))
    out = statements.diagnosis(digests, explain, existing_indexes(spark, d))
    return out.select("digest", F.array_join("flags", "; ").alias("flags"), "parameterized", "covered", "tbl",
                      F.array_join("cols", ",").alias("cols"), "confidence")


@query("payload_bloat", """
SELECT CAST(sum(strlen(props)) AS BIGINT) AS total_bytes, count(*) AS n, sum(strlen(props)) >= 819200 AS bloated FROM events""")
def payload_bloat(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return statements.payload_bloat(e.select(F.col("event_id").alias("name"), F.col("props").alias("value")))


@query("largest_payloads", """
SELECT doc_id AS name, strlen(text) AS bytes FROM documents ORDER BY bytes DESC, name LIMIT 10""")
def largest_payloads(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return statements.largest_payloads(docs.select(F.col("doc_id").alias("name"), F.col("text").alias("value")))
