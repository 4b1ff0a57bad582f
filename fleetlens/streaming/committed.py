"""Streams whose results are tables by batch, each batch counted exactly once.

A batch writes its tables first and its commit row last. Readers see committed
batches only, and a committed batch is not written again, so a replay after a
failure at any point gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.ordered import ordered_scan
from fleetlens.plans.packages import new_since
from fleetlens.session import staged
from fleetlens.streaming.monitor import _put, by_batch, results

RUN = "run string, project string, type string, package string, latest string, security boolean"
REQUEST = "host string, event_time timestamp, ms double, failed boolean"
PART = "window_start timestamp, host string, requests bigint, errors bigint, sketch binary"
STRETCH = "host string, first bigint, last bigint, requests bigint"
HIGH = "high timestamp"

Step = Callable[[DataFrame, int], None]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_committed(spark: SparkSession, root: str, batch_id: int) -> bool:
    return _exists(spark, f"{root}/commits/batch={batch_id}/_SUCCESS")


def commit(spark: SparkSession, root: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a batch, then its commit row."""
    for name, df in tables.items():
        _put(df, root, name, batch_id)
    _put(spark.range(1).select(F.lit(batch_id).cast("bigint").alias("id")), root, "commits", batch_id)


def committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table from all committed batches, with their `batch`."""
    if not _exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    done = results(spark, root, "commits", "id bigint").select(F.col("id").alias("batch"))
    return results(spark, root, name, schema).join(done, "batch", "left_semi").select(*spark.createDataFrame([], schema).columns, "batch")


# --- history of runs ----------------------------------------------------------------------

def history_step(root: str) -> Step:
    """A batch is a run: it is added to `runs`, and what is new against the run before goes to `new`.

    New: a package absent before, with a moved latest version, or newly a security matter.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, root, batch_id):
            return
        now = staged(batch, "run")
        before = committed(spark, root, "runs", RUN).where(F.col("batch") == batch_id - 1).drop("batch")
        commit(spark, root, batch_id, {"runs": now, "new": new_since(now, before)})

    return step


def run_history(runs: DataFrame, root: str) -> StreamingQuery:
    """Keep every run of a stream (columns of RUN), and what each has new; `committed(.., "runs" or "new", RUN)` reads them."""
    return by_batch(runs.select(*[c.split()[0] for c in RUN.split(", ")]), history_step(root), root)


# --- latency by window, sessions ----------------------------------------------------------

def latency_step(root: str, length: str, gap: int, delay: str, k: int) -> Step:
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, root, batch_id):
            return
        rows = staged(batch.select("host", "event_time", "ms", "failed"), "requests")
        high = committed(spark, root, "high", HIGH).agg(F.max("high").alias("high"))
        known = rows.join(F.broadcast(high)).withColumn("late", F.coalesce(F.col("event_time") < F.col("high") - F.expr(f"INTERVAL {delay}"), F.col("event_time").isNull()))
        known = staged(known, "requests")
        on_time = known.where("NOT late")
        parts = on_time.groupBy(F.window("event_time", length), "host").agg(
            F.count("*").alias("requests"), F.count_if("failed").alias("errors"), F.kll_sketch_agg_double("ms", F.lit(k)).alias("sketch")).select(
            F.col("window.start").alias("window_start"), "host", "requests", "errors", "sketch")
        stretches = on_time.where("host IS NOT NULL").groupBy(F.session_window("event_time", f"{gap} seconds"), "host").agg(
            F.unix_micros(F.min("event_time")).alias("first"), F.unix_micros(F.max("event_time")).alias("last"), F.count("*").alias("requests")).select(
            "host", "first", "last", "requests")
        commit(spark, root, batch_id, {
            "late": known.where("late").select("host", "event_time", "ms", "failed"), "parts": parts, "stretches": stretches,
            "high": known.agg(F.max("event_time").alias("high"))})

    return step


def latency_stream(requests: DataFrame, root: str, length: str = "1 hour", gap: int = 1800, delay: str = "1 hour", k: int = 400) -> StreamingQuery:
    """Requests (columns of REQUEST) by window and host, and the sessions of each host, as partial tables per batch.

    Rows that are `delay` behind the newest instant of the batches before are late: they
    count nowhere and are kept in the table `late`, as are rows without an instant.
    A null host has windows but no sessions. `k` sets the size of the
    quantile sketches: a window's p95 has a rank within about 2.3 / k of 95 % of its
    requests (99 % confidence; 0.7 % for 400), and is exact for k requests or fewer.
    """
    return by_batch(requests, latency_step(root, length, gap, delay, k), root)


def latency(spark: SparkSession, root: str) -> DataFrame:
    """(window_start, host, requests, errors, p95): the partial rows of all batches merged."""
    merged = committed(spark, root, "parts", PART).groupBy("window_start", "host").agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch").alias("sketch"))
    p95 = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)))
    return merged.select("window_start", "host", "requests", "errors", p95.alias("p95"))


def sessions(spark: SparkSession, root: str, gap: int = 1800) -> DataFrame:
    """(host, start, end, requests) in microseconds: stretches of the batches that come within `gap` seconds are one session.

    A session starts where no stretch is open: openers and closers are rows in order
    of time, and the running number of open ones tells. A closer precedes an opener
    of its instant, as a session ends `gap` after its last request.
    """
    part = committed(spark, root, "stretches", STRETCH)
    marks = part.select("host", F.explode(F.array(
        F.struct(F.col("first").alias("at"), F.lit(1).alias("step"), F.col("requests").alias("n")),
        F.struct((F.col("last") + gap * 1_000_000).alias("at"), F.lit(-1).alias("step"), F.lit(0).cast("bigint").alias("n")))).alias("m"), "batch").select(
        "host", "m.*", "batch")
    opened = ordered_scan(marks, ["host"], ["at", "step", "batch"], sums={"open": "step"}).withColumn(
        "starts", F.when((F.col("step") == 1) & (F.col("open") == 1), 1).otherwise(0))
    numbered = ordered_scan(opened, ["host"], ["at", "step", "batch"], sums={"number": "starts"})
    return numbered.groupBy("host", "number").agg(F.min("at").alias("start"), (F.max("at") - gap * 1_000_000).alias("end"), F.sum("n").alias("requests")).drop("number")
