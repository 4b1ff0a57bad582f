"""Streaming twins of the history operators.

Ordered state (open incidents, last firings) is a small table per micro-batch in
the shared folder. A batch is joined with the table of the batch before and goes
through the batch operators, so a key that owns a third of a batch is spread like
anywhere else, and a replayed batch overwrites its own results only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import history
from fleetlens.plans.packages import new_since
from fleetlens.session import staged, staging_root

INCIDENT = "host string, start bigint, `end` bigint, runs bigint"
ALERT = "key string, ts bigint, fired boolean, late boolean"
LAST = "key string, last bigint"


def by_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch that is there to `step`, then stop."""
    return (stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())


def _put(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")


def results(spark: SparkSession, root: str, name: str, schema: str, last: bool = False) -> DataFrame:
    """What all batches (or the last one alone) gave out under a name; `batch` is the batch id."""
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    if not last:
        return rows
    newest = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").select("batch").inputFiles()
    ids = [int(f.split("/batch=")[1].split("/")[0]) for f in newest]
    return rows.where(F.col("batch") == max(ids, default=-1))


def suppress_alerts(alerts: DataFrame, window: int, root: str) -> StreamingQuery:
    """Decide a stream of (key, ts ms) alerts batch by batch; `results(.., "alerts", ALERT)` has every one of them.

    State per key is the last fired instant. Rows of a batch may come in any order.
    An alert earlier than its key's last firing in a batch before is late: it doesn't
    fire, and is marked.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch.select("key", "ts"), "alerts")
        spark = rows.sparkSession
        before = spark.read.schema(LAST).parquet(f"{root}/last/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], LAST)
        known = rows.join(before, "key", "left").withColumn("late", F.coalesce(F.col("ts") < F.col("last"), F.lit(False)))
        known = staged(known, "alerts")
        times = known.where("NOT late").select("key", "ts").union(before.select("key", "last"))
        fired = staged(history.fired_instants(times, window), "fired")
        _put(known.join(fired.withColumn("f", F.lit(True)), ["key", "ts"], "left").select(
            "key", "ts", (F.coalesce("f", F.lit(False)) & ~F.col("late")).alias("fired"), "late"), root, "alerts", batch_id)
        _put(fired.groupBy("key").agg(F.max("ts").alias("last")), root, "last", batch_id)

    return by_batch(alerts, step, root)


def incident_stream(probes: DataFrame, root: str) -> StreamingQuery:
    """Incidents of a stream of (host, ts, seq, status): closed ones by batch, open ones as of each batch.

    Closed: `results(.., "closed", INCIDENT)`; still open, with null end:
    `results(.., "open", INCIDENT, last=True)`. State per host is its open incident,
    which enters the next batch as one row that stands for its probes. Batches must
    follow each other in time; within a batch rows may come in any order.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("host", "ts", "seq", "status", F.lit(1).cast("bigint").alias("w"))
        if batch_id:
            left = batch.sparkSession.read.schema(INCIDENT).parquet(f"{root}/open/batch={batch_id - 1}")
            rows = rows.union(left.select("host", "start", F.lit(-1).cast("bigint"), F.lit("red"), "runs"))
        found = staged(history.incidents(rows, "w").select("host", "start", "end", "runs"), "incidents")
        _put(found.where("`end` IS NOT NULL"), root, "closed", batch_id)
        _put(found.where("`end` IS NULL"), root, "open", batch_id)

    return by_batch(probes, step, root)


UPTIME = "window_start timestamp, host string, checks bigint, green bigint"


def windowed_uptime(probes: DataFrame, root: str, late: str = "10 minutes", length: str = "1 hour") -> StreamingQuery:
    """Per host and window: checks and green checks, kept up to date; `current_uptime` has every window, open ones too.

    Rows later than `late` are not counted; Spark's progress reports their number
    (numRowsDroppedByWatermark).
    """
    counted = probes.withWatermark("event_time", late).groupBy(F.window("event_time", length), "host").agg(
        F.count("*").alias("checks"), F.count_if(F.col("status") == "green").alias("green"),
    ).select(F.col("window.start").alias("window_start"), "host", "checks", "green")
    return by_batch(counted, lambda batch, batch_id: _put(batch, root, "uptime", batch_id), root, "update")


def current_uptime(spark: SparkSession, root: str) -> DataFrame:
    newest = F.max_by(F.struct("checks", "green"), "batch").alias("v")
    return results(spark, root, "uptime", UPTIME).groupBy("window_start", "host").agg(newest).select("window_start", "host", "v.*")


def once_per_url(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Crawl records with each url kept once within the watermark."""
    return records.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["url"])


def append_history(runs: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append every new run to a partitioned history, then stop; replaces a cron job."""
    root = checkpoint or f"{staging_root(runs.sparkSession)}/history-checkpoint"
    return (
        runs.writeStream.format("parquet").partitionBy("run_date").outputMode("append")
        .option("checkpointLocation", root).option("path", path).trigger(availableNow=True).start()
    )


def new_since_last_run(runs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, history: str) -> StreamingQuery:
    """Per micro-batch: rows new against the last committed run, handed to `sink`; then that run becomes the history.

    Runs are kept under their batch id, so a replayed batch compares with the
    same earlier run and overwrites only its own.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = f"{history}/run={batch_id}"
        batch.write.mode("overwrite").parquet(now)
        current = spark.read.parquet(now)
        earlier = spark.read.parquet(f"{history}/run={batch_id - 1}") if batch_id else current.limit(0)
        sink(new_since(current, earlier), batch_id)

    return (
        runs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
