"""Lookups on a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot when it owns at least this share of the rows, so at most
# 1 / HOT_SHARE keys are hot: the broadcast side has a fixed row bound.
HOT_SHARE = 1e-4
SPREAD = 1024


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that own at least HOT_SHARE of `rows` (bounded in number)."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") >= total * F.lit(HOT_SHARE)).select(key)


def lookup(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    spread: list[str | Column],
    how: str = "left",
    base: DataFrame | None = None,
    weight: str | None = None,
    hot: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Join `rows` to `dim` (at most one row per `key`) when `key` may be skewed in `rows`.

    Hot keys are answered from a broadcast of their few dim rows; their rows
    then spread over the shuffle by a hash of `spread` instead of meeting in
    one task. All other rows take an ordinary shuffled join.

    `base`, a staged table with the same rows, answers how often keys occur without
    running `rows` twice. `hot` hands in hot keys found before. `weight` names a dim
    column that already holds the row counts. `tasks` is the number of tasks of the
    shuffle, by default as many as any has. The result has the columns of `rows`,
    then those of `dim`, at every size.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    extra = [c for c in dim.columns if c != key]
    if hot is not None:
        pass
    elif weight:
        total = dim.agg(F.sum(weight)).scalar()
        hot = dim.where(F.col(weight) >= total * F.lit(HOT_SHARE)).select(key)
    else:
        hot = hot_keys(rows if base is None else base, key)
    hot_dim = dim.join(F.broadcast(hot), key, "left_semi").select(
        key, F.struct(F.lit(True).alias("_hit"), *extra).alias("_hot")
    )
    flagged = rows.join(F.broadcast(hot_dim), key, "left")
    is_hot = F.col("_hot").isNotNull()
    left = flagged.withColumn("_jk", F.when(~is_hot, F.col(key))).withColumn(
        "_sp", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SPREAD))).otherwise(F.lit(0))
    )
    right = dim.select(
        F.col(key).alias("_jk"), F.lit(0).cast("bigint").alias("_sp"),
        F.struct(F.lit(True).alias("_hit"), *extra).alias("_cold"),
    )
    if tasks:
        left, right = left.repartition(tasks, "_jk", "_sp"), right.repartition(tasks, "_jk", "_sp")
    joined = left.join(right, ["_jk", "_sp"], "left").withColumn(
        "_got", F.coalesce("_hot", "_cold")
    )
    if how == "inner":
        joined = joined.where(F.col("_got").isNotNull())
    keep = [F.col(c) for c in rows.columns]
    return joined.select(*keep, *[F.col(f"_got.{c}").alias(c) for c in extra])
