"""Which interval holds a point, for disjoint closed intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from fleetlens.operators.ordered import ordered_scan


def _common(points: DataFrame, intervals: DataFrame, value: str) -> DataType:
    """The type that holds both the points and the bounds, as comparing them would choose."""
    spark = points.sparkSession
    empty = spark.createDataFrame([], StructType([StructField("a", points.schema[value].dataType), StructField("b", intervals.schema["lo"].dataType)]))
    return empty.select(F.coalesce("a", "b").alias("x")).schema["x"].dataType


def interval_lookup(points: DataFrame, intervals: DataFrame, value: str, ident: str, labels: list[str]) -> DataFrame:
    """points plus the `labels` of the interval [lo, hi] that holds `value`, null when none does.

    Points and intervals are merged in order: the last interval that starts at or
    before a point is the only one that can hold it. A null value has no interval.
    """
    kind = _common(points, intervals, value)
    band = F.struct(F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"), *labels)
    marks = intervals.select(F.col("lo").cast(kind).alias("_at"), F.lit(0).alias("_kind"), F.lit("").alias("_tie"), band.alias("_band"))
    asks = points.select(F.col(value).cast(kind).alias("_at"), F.lit(1).alias("_kind"), F.col(ident).cast("string").alias("_tie"),
                         F.struct(*points.columns).alias("_p"))
    merged = marks.unionByName(asks, allowMissingColumns=True)
    scan = ordered_scan(merged, [], ["_at", "_kind", "_tie"], carry={"_found": "_band"}).where("_kind = 1")
    inside = F.col("_at") <= F.col("_found.hi")
    return scan.select("_p.*", *[F.when(inside, F.col(f"_found.{c}")).alias(c) for c in labels])


def outside_intervals(points: DataFrame, intervals: DataFrame, value: str, ident: str, keys: list[str]) -> DataFrame:
    """The points that none of the intervals [lo, hi] of the same `keys` holds; intervals may overlap.

    Some interval holds a point when the largest `hi` among those that start at or
    before it reaches it, so one running maximum decides and nothing is paired.
    """
    kind = _common(points, intervals, value)
    marks = intervals.select(*keys, F.col("lo").cast(kind).alias("_at"), F.lit(0).alias("_kind"), F.concat_ws("|", "hi", "lo").alias("_tie"),
                             F.col("hi").cast(kind).alias("_hi")).distinct()
    asks = points.select(*keys, F.col(value).cast(kind).alias("_at"), F.lit(1).alias("_kind"), F.col(ident).cast("string").alias("_tie"),
                         F.struct(*points.columns).alias("_p"))
    scan = ordered_scan(marks.unionByName(asks, allowMissingColumns=True), keys, ["_at", "_kind", "_tie"], maxes={"_reach": "_hi"})
    return scan.where((F.col("_kind") == 1) & (F.col("_reach").isNull() | (F.col("_reach") < F.col("_at")))).select("_p.*")
