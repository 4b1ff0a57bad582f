"""Probe history: uptime, incidents, latest state, alert suppression, concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fleetlens.functions.text import round_half_up
from fleetlens.operators.ordered import ordered_scan
from fleetlens.session import staged


def uptime(probes: DataFrame) -> DataFrame:
    """Per host: rows, green rows and uptime percent with one decimal."""
    return probes.groupBy("host").agg(
        F.count("*").alias("checks"), F.count_if(F.col("status") == "green").alias("green"),
    ).withColumn(
        "uptime_pct", round_half_up(F.col("green") / F.col("checks") * F.lit(1000)) / 10
    )


def latest(probes: DataFrame, cols: list[str]) -> DataFrame:
    """Per host: the last row by (ts, seq)."""
    last = F.max_by(F.struct(*cols), F.struct("ts", "seq"))
    return probes.groupBy("host").agg(F.count("*").alias("runs"), last.alias("_l")).select(
        "host", "runs", *[F.col(f"_l.{c}").alias(f"last_{c}") for c in cols]
    )


def series(probes: DataFrame, metrics: list[str]) -> DataFrame:
    """(host, metric, number, ts, value): each metric's history in order, the rows without a value left out."""
    long = probes.select("host", "ts", "seq", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))).where("value IS NOT NULL")
    counted = ordered_scan(long.withColumn("_one", F.lit(1).cast("bigint")), ["host", "metric"], ["ts", "seq"], sums={"number": "_one"})
    return counted.select("host", "metric", "number", "ts", "value")


def incidents(probes: DataFrame, weight: str | None = None) -> DataFrame:
    """Runs of consecutive red rows per host: start, end (null while open), number of red rows.

    `weight` names a column that says how many probes a row stands for.

    A red row belongs to the gap after the k-th non-red row, and the (k+1)-th
    non-red row ends it, so numbering the non-red rows is all that is needed.
    """
    flagged = probes.select(
        "host", "ts", "seq", (F.col("status") == "red").alias("_red"),
        (F.col("status") != "red").cast("bigint").alias("_calm"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"),
    )
    scan = ordered_scan(flagged, ["host"], ["ts", "seq"], sums={"_k": "_calm"})
    gap = F.col("_k") - F.col("_calm")
    return (
        scan.groupBy("host", gap.alias("_gap"))
        .agg(
            F.min(F.when(F.col("_red"), F.col("ts"))).alias("start"),
            F.min(F.when(~F.col("_red"), F.col("ts"))).alias("end"),
            F.coalesce(F.sum(F.when(F.col("_red"), F.col("_w"))), F.lit(0)).alias("runs"),
        )
        .where(F.col("runs") > 0)
        .drop("_gap")
    )


#: The instants of a key that a task walks, at most.
WALK = 1_000_000


def fired_instants(alerts: DataFrame, window: int, walk: int = WALK) -> DataFrame:
    """(key, ts) instants that fire when a key stays silent for `window` after each firing.

    The silence counts from the last *fired* instant, so it is no lag: firing
    instants are those on the path of 'next instant at least `window` later' from a
    key's first one. A key of at most `walk` instants is walked in order, in one pass
    over its task. The path of a longer one is found by pointer doubling, which no single
    task has to hold, whatever a key's share of the alerts.
    """
    times = staged(alerts.select("key", "ts").distinct(), "instants")
    # At most one in `walk` rows.
    long = staged(times.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > walk).select("key"), "long")
    if long.isEmpty():
        return _walked(times, window)
    short = _walked(times.join(F.broadcast(long), "key", "left_anti"), window)
    return short.unionByName(_double(staged(times.join(F.broadcast(long), "key", "left_semi"), "instants"), window))


def _walked(times: DataFrame, window: int) -> DataFrame:
    """Instants on the path, by going through each key's in order; only the last one fired is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, last = False, None, None
        for batch in batches:
            fires = []
            for k, ts in zip(batch.column("key").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                first = not begun or k != key
                fire = first or (k is not None and ts is not None and ts - last >= window)
                if fire:
                    begun, key, last = True, k, ts
                fires.append(fire)
            yield batch.filter(pa.array(fires, pa.bool_()))

    in_order = times.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("ts"))
    return in_order.mapInArrow(run, times.schema)


def _double(times: DataFrame, window: int) -> DataFrame:
    """Instants on the path first -> next -> next..., by pointer doubling."""
    probes = times.select("key", (F.col("ts") + window).alias("at"), F.col("ts").alias("src"),
                          F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("hit"))
    marks = times.select("key", F.col("ts").alias("at"), F.col("ts").alias("src"),
                         F.lit(2).alias("kind"), F.col("ts").alias("hit"))
    # Scanned backwards an instant precedes the probe at the same time: 'at least window later'.
    scan = ordered_scan(probes.unionByName(marks), ["key"], ["at", "kind", "src"],
                        carry={"nxt": "hit"}, reverse=True)
    jump = staged(scan.where("kind = 1 and nxt is not null").select(
        "key", F.col("src").alias("ts"), "nxt"), "jump")
    reached = staged(times.groupBy("key").agg(F.min("ts").alias("ts")), "reached")
    count = reached.count()
    while True:
        step = reached.join(jump, ["key", "ts"]).select("key", F.col("nxt").alias("ts"))
        reached = staged(reached.unionByName(step).distinct(), "reached")
        grown = reached.count()
        if grown == count:
            return reached
        count = grown
        far = jump.select("key", F.col("ts").alias("nxt"), F.col("nxt").alias("nxt2"))
        jump = staged(jump.join(far, ["key", "nxt"]).select("key", "ts", F.col("nxt2").alias("nxt")), "jump")


def suppress_alerts(alerts: DataFrame, window: int) -> DataFrame:
    """Every alert with fired = true or false; alerts of the same key and instant share the answer."""
    fired = fired_instants(alerts, window).withColumn("_f", F.lit(True))
    return alerts.join(fired, ["key", "ts"], "left").withColumn(
        "fired", F.coalesce("_f", F.lit(False))
    ).drop("_f")


def peak_concurrency(tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Most tasks (start, end) running at one time, in all or per key.

    Starts and ends collapse to one delta per instant first; at equal instants
    ends come before starts.
    """
    keys = keys or []
    deltas = (
        tasks.select(*keys, F.explode(F.array(
            F.struct(F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("d")),
            F.struct(F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("d")),
        )).alias("e"))
        .groupBy(*keys, F.col("e.at").alias("at"), F.col("e.kind").alias("kind"))
        .agg(F.sum("e.d").alias("d"))
    )
    return ordered_scan(deltas, keys, ["at", "kind"], sums={"running": "d"}).groupBy(*keys).agg(
        F.max("running").alias("peak")
    )


def stage_telemetry(tasks: DataFrame) -> DataFrame:
    """Per stage: total duration, cache hits and misses, retries."""
    return tasks.groupBy("stage").agg(
        F.sum("duration_ms").alias("duration_ms"),
        F.count_if(F.col("cached")).alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses"),
        F.sum("retries").alias("retries"),
    )


def slowest_stage(telemetry: DataFrame) -> DataFrame:
    """The one stage with the largest total duration; the smallest name wins a tie."""
    return telemetry.orderBy(F.desc("duration_ms"), "stage").limit(1).select("stage", "duration_ms")


ERROR_CLASS = T.StructType([T.StructField("retryable", T.BooleanType()), T.StructField("fatal", T.BooleanType())])
# Error codes and message parts that are worth a retry. Fixed values.
RETRYABLE_CODES = ("ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "ENOTFOUND", "EADDRINUSE", "EPIPE")
RETRYABLE_TEXT = ("timeout", "time out", "network", "fetch failed", "socket", "hang up", "aborted",
                  "playwright", "navigation failed")


def classify_errors(errors: DataFrame) -> DataFrame:
    """Add `retryable` from (status, code, message): HTTP status decides when present."""
    text = F.lower(F.coalesce("message", F.lit("")))
    known = F.col("code").isin(*RETRYABLE_CODES)
    for part in RETRYABLE_TEXT:
        known = known | text.contains(part)
    by_status = (F.col("status") == 429) | F.col("status").between(500, 504)
    return errors.withColumn(
        "retryable",
        F.when(F.coalesce("status", F.lit(0)) != 0, by_status).otherwise(F.coalesce(known, F.lit(False))),
    )
