"""Probe-history queries: events stand in for probes, one host per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators import history
from fleetlens.queries.registry import query, table


def probes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "red").when(F.col("event_type") == "view", "amber").otherwise("green")
    return table(spark, d, "events").select(
        F.concat(F.lit("host"), F.col("user_id")).alias("host"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"),
        status.alias("status"), F.col("value").alias("days_left"),
    )


PROBES = """
probes AS (SELECT 'host' || user_id AS host, epoch_us(ts) // 1000 AS ts, event_id AS seq, value AS days_left,
  CASE event_type WHEN 'error' THEN 'red' WHEN 'view' THEN 'amber' ELSE 'green' END AS status FROM events)"""


@query("uptime_pct", f"""
WITH {PROBES}
SELECT host, count(*) AS checks, count(*) FILTER (status = 'green') AS green,
       floor(count(*) FILTER (status = 'green') / count(*) * 1000 + 0.5) / 10 AS uptime_pct
FROM probes GROUP BY host""")
def uptime_pct(spark: SparkSession, d: str) -> DataFrame:
    return history.uptime(probes(spark, d))


@query("host_latest", f"""
WITH {PROBES}
SELECT host, count(*) AS runs, arg_max(status, (ts, seq)) AS last_status, arg_max(days_left, (ts, seq)) AS last_days_left
FROM probes GROUP BY host""")
def host_latest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(probes(spark, d), ["status", "days_left"])


@query("incidents", f"""
WITH {PROBES},
k AS (SELECT *, status = 'red' AS red,
        sum(CASE WHEN status <> 'red' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, seq) AS calm FROM probes)
SELECT r.host, r.start, n.ts AS "end", r.runs
FROM (SELECT host, calm, min(ts) AS start, count(*) AS runs FROM k WHERE red GROUP BY host, calm) r
LEFT JOIN k n ON n.host = r.host AND NOT n.red AND n.calm = r.calm + 1""")
def incidents(spark: SparkSession, d: str) -> DataFrame:
    return history.incidents(probes(spark, d))


HOUR = 3_600_000


@query("alert_suppress", f"""
WITH RECURSIVE alerts AS (
  SELECT user_id || '|' || event_type AS key, epoch_us(ts) // 1000 AS ts, event_id FROM events),
fired AS (
  SELECT key, min(ts) AS ts FROM alerts GROUP BY key
  UNION ALL
  SELECT key, ts FROM (
    SELECT f.key, (SELECT min(a.ts) FROM alerts a WHERE a.key = f.key AND a.ts >= f.ts + {6 * HOUR}) AS ts FROM fired f)
  WHERE ts IS NOT NULL)
SELECT a.key, a.ts, a.event_id, f.key IS NOT NULL AS fired
FROM alerts a LEFT JOIN fired f ON a.key = f.key AND a.ts = f.ts""")
def alert_suppress(spark: SparkSession, d: str) -> DataFrame:
    alerts = table(spark, d, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_id",
    )
    return history.suppress_alerts(alerts, 6 * HOUR)


def tasks(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    ms = F.floor(F.col("value") * 1000).cast("bigint")
    return table(spark, d, "events").select(
        F.col("event_type").alias("stage"), start.alias("start"), (start + ms).alias("end"),
        ms.alias("duration_ms"), (F.col("event_id") % 3 == 0).alias("cached"), (F.col("event_id") % 5).alias("retries"),
    )


TASKS = """
tasks AS (SELECT event_type AS stage, epoch_us(ts) // 1000 AS start, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS fin,
  CAST(floor(value * 1000) AS BIGINT) AS duration_ms, event_id % 3 = 0 AS cached, event_id % 5 AS retries FROM events),
deltas AS (SELECT stage, start AS t, 1 AS d FROM tasks UNION ALL SELECT stage, fin, -1 FROM tasks)"""


@query("peak_concurrency", f"""
WITH {TASKS}
SELECT CAST(max(running) AS BIGINT) AS peak FROM (
  SELECT sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS running FROM deltas)""")
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return history.peak_concurrency(tasks(spark, d))


@query("peak_concurrency_by_stage", f"""
WITH {TASKS}
SELECT stage, CAST(max(running) AS BIGINT) AS peak FROM (
  SELECT stage, sum(d) OVER (PARTITION BY stage ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS running FROM deltas) GROUP BY stage""")
def peak_concurrency_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return history.peak_concurrency(tasks(spark, d), ["stage"])


@query("stage_telemetry", f"""
WITH {TASKS}
SELECT stage, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (cached) AS cache_hits,
       count(*) FILTER (NOT cached) AS cache_misses, CAST(sum(retries) AS BIGINT) AS retries FROM tasks GROUP BY stage""")
def stage_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return history.stage_telemetry(tasks(spark, d))


@query("slowest_stage", f"""
WITH {TASKS}
SELECT stage, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM tasks GROUP BY stage ORDER BY 2 DESC, 1 LIMIT 1""")
def slowest_stage(spark: SparkSession, d: str) -> DataFrame:
    return history.slowest_stage(history.stage_telemetry(tasks(spark, d)))
