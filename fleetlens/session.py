"""Session settings and the staging folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's switch that removes a query's shuffle files when it ends, not when the driver's garbage collector comes to them.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own: elsewhere a
    machine-local path would be lost with its executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="fleetlens-stage-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def run_root(spark: SparkSession) -> str:
    """The folder of this application within the staging root; everything staged lies in it."""
    return os.path.join(staging_root(spark), f"fleetlens-{spark.sparkContext.applicationId}")


def release(spark: SparkSession) -> None:
    """Remove what this application has staged; call it when no result that was built on it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once to the staging folder and read it back.

    The result has no lineage, survives the loss of any executor, and is
    columnar, so later readers prune what they do not need. Nothing reads the shuffle
    files of the write again, so they go at its end.
    """
    spark = df.sparkSession
    path = os.path.join(run_root(spark), f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that `staged` has written, before the application ends; nothing that is still to run may read them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
