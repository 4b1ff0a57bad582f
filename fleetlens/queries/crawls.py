"""Metadata comparison queries: customers before and after a migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators.crawls import compare_crawls
from fleetlens.queries.registry import query, table


def before(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("seq"), F.concat(F.lit("https://old.test/c/"), k, F.lit("?b=1&a=2")).alias("url"), F.lit("200").alias("status"),
        F.concat(F.lit(" Customer  "), k).alias("title"), F.col("c_mktsegment").alias("description"),
        F.concat(F.lit("https://old.test/c/"), k, F.lit("/")).alias("canonical"), F.lit("noindex, Follow").alias("robots"),
        F.lit("en_US").alias("language"), F.concat(F.lit('["b '), k, F.lit('", "a"]')).alias("H1"),
        F.lit('{"@type": "Product", "x": {"@type": ["Offer", "Thing"]}}').alias("schema_types"), F.col("c_name").alias("content_fingerprint"))
    extra = rows.where("seq % 40 = 0").withColumn("seq", F.col("seq") + 10_000_000).withColumn("title", F.lit("late"))
    return rows.unionByName(extra)


def after(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    moved = F.when(k % 10 == 0, F.concat(F.lit("https://new.test/moved/"), k)).otherwise(F.concat(F.lit("https://new.test/c/"), k, F.lit("?a=2&b=1")))
    return table(spark, d, "customer").where(k % 13 != 0).select(
        k.alias("seq"), moved.alias("url"), F.when(k % 7 == 0, "404").otherwise("200").alias("status"),
        F.concat(F.lit("Customer "), F.when(k % 9 == 0, k + 1).otherwise(k)).alias("title"), F.lower("c_mktsegment").alias("description"),
        F.concat(F.lit("/c/"), k).alias("canonical"), F.lit("follow,noindex").alias("robots"), F.lit("EN-us").alias("language"),
        F.concat(F.lit("a\nb  "), k).alias("H1"), F.when(k % 8 == 0, "Offer").otherwise("Thing, Offer,Product").alias("schema_types"),
        F.when(k % 6 == 0, "x").otherwise(F.col("c_name")).alias("content_fingerprint"))


def mapping(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    base = table(spark, d, "customer").where(k % 20 == 0).select(
        k.alias("seq"), F.concat(F.lit("https://old.test/c/"), k, F.lit("?b=1&a=2")).alias("src"),
        F.concat(F.lit("https://new.test/moved/"), k).alias("dest"))
    return base.unionByName(base.where("seq % 100 = 0").withColumn("seq", F.col("seq") + 10_000_000))


@query("metadata_compare", """
WITH k AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_name, c_custkey % 13 <> 0 AS there, c_custkey % 10 = 0 AS moved FROM customer),
u AS (SELECT *, 'https://old.test/c/' || k || '?b=1&a=2' AS ub, CASE WHEN moved THEN 'https://new.test/moved/' || k ELSE 'https://new.test/c/' || k || '?a=2&b=1' END AS ua FROM k),
pairs AS (SELECT * FROM u WHERE there AND NOT moved UNION ALL SELECT * FROM u WHERE there AND k % 20 = 0 UNION ALL SELECT * FROM u WHERE there AND k % 100 = 0)
SELECT ub AS url_before, NULL AS url_after, 'duplicate' AS field, '2 duplicate rows' AS before, '' AS after, 'warning' AS severity FROM u WHERE k % 40 = 0
UNION ALL SELECT ub, 'https://new.test/moved/' || k, 'duplicate', 'source mapped before', 'destination mapped before', 'warning' FROM u WHERE k % 100 = 0
UNION ALL SELECT ub, 'https://new.test/moved/' || k, 'mapping', 'present', 'absent', 'warning' FROM u, (SELECT unnest([1, 2]) AS i) WHERE NOT there AND (k % 20 = 0 AND i = 1 OR k % 100 = 0 AND i = 2)
UNION ALL SELECT ub, NULL, 'mapping', 'no counterpart', '', 'warning' FROM u WHERE k % 20 <> 0 AND (moved OR NOT there)
UNION ALL SELECT NULL, ua, 'mapping', '', 'no counterpart', 'warning' FROM u WHERE there AND moved AND k % 20 <> 0
UNION ALL SELECT ub, ua, 'status', '200', '404', 'error' FROM pairs WHERE k % 7 = 0
UNION ALL SELECT ub, ua, 'title', ' Customer  ' || k, 'Customer ' || (k + 1), 'error' FROM pairs WHERE k % 9 = 0
UNION ALL SELECT ub, ua, 'description', seg, lower(seg), 'warning' FROM pairs WHERE seg <> lower(seg)
UNION ALL SELECT ub, ua, 'content_fingerprint', c_name, 'x', 'error' FROM pairs WHERE k % 6 = 0""")
def metadata_compare(spark: SparkSession, d: str) -> DataFrame:
    return compare_crawls(before(spark, d), after(spark, d), mapping(spark, d),
                          {"schema_types": "ignore", "content_fingerprint": "error"})
