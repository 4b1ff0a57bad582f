"""Streaming queries: events are read as a file stream and drained with availableNow."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.queries.monitor import HOUR, PROBES
from fleetlens.queries.registry import query, table
from fleetlens.session import run_root
from fleetlens.streaming import committed as C, monitor as S


SLICES = 3


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of SLICES micro-batches that follow each other in time."""
    events = table(spark, d, "events")
    root = os.path.join(run_root(spark), f"events-{uuid.uuid4().hex}")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    for i in range(SLICES):
        bounds = [low + (high - low) * k / SLICES for k in (i, i + 1)]
        inside = (F.col("ts") >= bounds[0]) & ((F.col("ts") < bounds[1]) if i < SLICES - 1 else (F.col("ts") <= high))
        events.where(inside).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root).withColumn(
        "event_time", F.col("ts").cast("timestamp"))


def run_folder(spark: SparkSession) -> str:
    return os.path.join(run_root(spark), f"stream-{uuid.uuid4().hex}")


@query("stream_alerts", f"""
WITH RECURSIVE alerts AS (
  SELECT user_id || '|' || event_type AS key, epoch_us(ts) // 1000 AS ts FROM events),
fired AS (
  SELECT key, min(ts) AS ts FROM alerts GROUP BY key
  UNION ALL
  SELECT key, ts FROM (
    SELECT f.key, (SELECT min(a.ts) FROM alerts a WHERE a.key = f.key AND a.ts >= f.ts + {6 * HOUR}) AS ts FROM fired f)
  WHERE ts IS NOT NULL)
SELECT a.key, a.ts, f.key IS NOT NULL AS fired FROM alerts a LEFT JOIN fired f ON a.key = f.key AND a.ts = f.ts""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    alerts = event_stream(spark, d).select(
        F.concat_ws("|", "user_id", "event_type").alias("key"), F.unix_millis("event_time").alias("ts"))
    root = run_folder(spark)
    S.suppress_alerts(alerts, 6 * HOUR, root).awaitTermination()
    return S.results(spark, root, "alerts", S.ALERT).select("key", "ts", "fired")


@query("stream_incidents", f"""
WITH {PROBES},
k AS (SELECT *, status = 'red' AS red,
        sum(CASE WHEN status <> 'red' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, seq) AS calm FROM probes)
SELECT r.host, r.start, n.ts AS "end", r.runs
FROM (SELECT host, calm, min(ts) AS start, count(*) AS runs FROM k WHERE red GROUP BY host, calm) r
LEFT JOIN k n ON n.host = r.host AND NOT n.red AND n.calm = r.calm + 1""")
def stream_incidents(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "red").otherwise("green")
    probes = event_stream(spark, d).select(F.concat(F.lit("host"), "user_id").alias("host"), F.unix_millis("event_time").alias("ts"),
                                           F.col("event_id").cast("bigint").alias("seq"), status.alias("status"))
    root = run_folder(spark)
    S.incident_stream(probes, root).awaitTermination()
    closed, still = S.results(spark, root, "closed", S.INCIDENT), S.results(spark, root, "open", S.INCIDENT, last=True)
    return closed.union(still).drop("batch")


@query("stream_uptime", """
WITH w AS (SELECT date_trunc('day', ts) AS day, 'host' || user_id AS host, event_type FROM events)
SELECT CAST(day AS VARCHAR) AS window_start, host, count(*) AS checks, count(*) FILTER (event_type NOT IN ('error', 'view')) AS green FROM w
GROUP BY 1, 2""")
def stream_uptime(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "red").when(F.col("event_type") == "view", "amber").otherwise("green")
    probes = event_stream(spark, d).select(F.concat(F.lit("host"), "user_id").alias("host"), "event_time", status.alias("status"))
    root = run_folder(spark)
    S.windowed_uptime(probes, root, length="1 day").awaitTermination()
    return S.current_uptime(spark, root).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_once_per_url", "SELECT count(DISTINCT user_id) AS urls FROM events")
def stream_once_per_url(spark: SparkSession, d: str) -> DataFrame:
    records = event_stream(spark, d).select(F.concat(F.lit("https://site.test/u/"), "user_id").alias("url"), "event_time")
    root = run_folder(spark)
    (S.once_per_url(records, "60 days").select("url").writeStream.format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("url string").parquet(f"{root}/out").agg(F.count("*").alias("urls"))


# --- exactly-once tables ------------------------------------------------------------------

GAP = 6 * 3600


def _latency(spark: SparkSession, d: str) -> str:
    requests = event_stream(spark, d).select(F.concat(F.lit("host"), "user_id").alias("host"), "event_time", F.col("value").alias("ms"), (F.col("event_type") == "error").alias("failed"))
    root = run_folder(spark)
    C.latency_stream(requests, root, length="1 day", gap=GAP).awaitTermination()
    return root


@query("stream_latency", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'host' || user_id AS host, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors,
  round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 3) AS error_pct, quantile_disc(value, 0.95) AS p95
FROM events GROUP BY 1, 2""")
def stream_latency(spark: SparkSession, d: str) -> DataFrame:
    """p95 equals the SQL while a host has 400 requests a day or fewer; beyond that it is within the sketch's rank error."""
    return C.latency(spark, _latency(spark, d)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "host", "requests", "errors",
        F.round(F.col("errors") * 100.0 / F.col("requests"), 3).cast("double").alias("error_pct"), "p95")


@query("stream_sessions", f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since, event_id FROM events),
s AS (SELECT *, sum(CASE WHEN since < {GAP * 1_000_000} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS number FROM e)
SELECT 'host' || user_id AS host, min(t) AS start, max(t) AS "end", count(*) AS requests FROM s GROUP BY user_id, number""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return C.sessions(spark, _latency(spark, d), GAP)


RUNS = """
run AS (SELECT r, p_brand AS project, 'pkg' || p_partkey AS package, 'v' || (p_size + CASE WHEN p_partkey % 5 < r THEN 1 ELSE 0 END) AS latest, p_partkey % 11 = r AS security
  FROM part, (SELECT unnest([0, 1, 2]) AS r) WHERE (p_partkey + r) % 7 <> 0)"""


def _runs(spark: SparkSession, d: str) -> str:
    """Three runs over all parts, one after the other, each read by the same stream as a cron job would."""
    k = F.col("p_partkey")
    root, source = run_folder(spark), os.path.join(run_root(spark), f"runs-{uuid.uuid4().hex}")
    for r in range(SLICES):
        table(spark, d, "part").where((k + r) % 7 != 0).select(
            F.lit(f"run{r}").alias("run"), F.col("p_brand").alias("project"), F.lit("npm").alias("type"), F.concat(F.lit("pkg"), k).alias("package"),
            F.concat(F.lit("v"), F.col("p_size") + F.when(k % 5 < r, 1).otherwise(0)).alias("latest"), (k % 11 == r).alias("security")).write.mode("append").parquet(source)
        C.run_history(spark.readStream.schema(C.RUN).parquet(source), root).awaitTermination()
    return root


@query("stream_history", f"WITH {RUNS} SELECT 'run' || r AS run, project, package, latest, security FROM run")
def stream_history(spark: SparkSession, d: str) -> DataFrame:
    return C.committed(spark, _runs(spark, d), "runs", C.RUN).select("run", "project", "package", "latest", "security")


@query("stream_new_since", f"""
WITH {RUNS}
SELECT 'run' || n.r AS run, n.project, n.package, n.latest FROM run n LEFT JOIN run b ON b.r = n.r - 1 AND b.project = n.project AND b.package = n.package
WHERE b.package IS NULL OR b.latest <> n.latest OR (n.security AND NOT b.security)""")
def stream_new_since(spark: SparkSession, d: str) -> DataFrame:
    return C.committed(spark, _runs(spark, d), "new", C.RUN).select("run", "project", "package", "latest")
