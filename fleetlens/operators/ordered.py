"""Ordered scans (running sum, carry-forward, rank) that never put one key in one task.

Rows are range-partitioned on (keys, order), so a key that owns a third of the
data is cut into as many slices as it needs. Each slice is scanned by itself;
one summary row per (slice, key) is scanned across slices; the two are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.session import staged


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str | tuple[str, bool]],
    *,
    sums: dict[str, str] | None = None,
    carry: dict[str, str] | None = None,
    carry_before: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    reverse: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add running columns to `df`, ordered by `order` within `keys`.

    sums          name -> column: inclusive running sum
    carry         name -> column: last non-null value up to this row
    carry_before  name -> column: last non-null value before this row
    totals        name -> column: sum over the whole key
    maxes         name -> column: inclusive running maximum
    `order` must be unique within `keys`; keys must not be null. An entry of `order`
    is a column, or a column and whether it descends; nulls come first ascending and
    last descending. Mixed directions go with sums, totals and maxes only.
    """
    sums, carry = dict(sums or {}), dict(carry or {})
    carry_before, totals, maxes = dict(carry_before or {}), dict(totals or {}), dict(maxes or {})

    ways = [(o, False) if isinstance(o, str) else o for o in order]
    order = [o for o, _ in ways]
    if (carry or carry_before) and any(desc for _, desc in ways):
        raise ValueError("carry goes with ascending columns and `reverse`")

    def sorted_cols(_: list[str]) -> list[Column]:
        return [F.col(n).desc() if desc != reverse else F.col(n).asc() for n, desc in ways]

    by = [F.col(k) for k in keys] + sorted_cols(order)
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    base = staged(ranged.withColumn("_slice", F.spark_partition_id()), "ordered")

    local = Window.partitionBy("_slice", *keys).orderBy(*sorted_cols(order))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    scanned = base.select(
        "*",
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_c_{n}") for n, c in carry.items()],
        *[F.last(c, ignorenulls=True).over(before).alias(f"_b_{n}") for n, c in carry_before.items()],
        *[F.max(c).over(upto).alias(f"_m_{n}") for n, c in maxes.items()],
    )

    pick = F.min_by if reverse else F.max_by
    position = F.struct(*order)
    carried = sorted(set(carry.values()) | set(carry_before.values()))
    summed = sorted(set(sums.values()) | set(totals.values()))
    summary = base.groupBy("_slice", *keys).agg(
        *[F.sum(c).alias(f"_ps_{c}") for c in summed],
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_pc_{c}") for c in carried],
        *[F.max(c).alias(f"_pm_{c}") for c in set(maxes.values())],
        F.count("*").alias("_rows"),
    )
    # At most one row per slice and key, so these windows are as small as the slice count.
    across = Window.partitionBy(*keys).orderBy("_slice")
    past = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = summary.select(
        "_slice", *keys,
        *[F.coalesce(F.sum(f"_ps_{c}").over(past), F.lit(0)).alias(f"_os_{c}") for c in set(sums.values())],
        *[F.last(f"_pc_{c}", ignorenulls=True).over(past).alias(f"_oc_{c}") for c in carried],
        *[F.coalesce(F.sum(f"_ps_{c}").over(whole), F.lit(0)).alias(f"_ot_{c}") for c in set(totals.values())],
        *[F.max(f"_pm_{c}").over(past).alias(f"_om_{c}") for c in set(maxes.values())],
    )
    return scanned.join(offsets, ["_slice", *keys]).select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.col(f"_os_{c}")).alias(n) for n, c in sums.items()],
        *[F.coalesce(f"_c_{n}", f"_oc_{c}").alias(n) for n, c in carry.items()],
        *[F.coalesce(f"_b_{n}", f"_oc_{c}").alias(n) for n, c in carry_before.items()],
        *[F.col(f"_ot_{c}").alias(n) for n, c in totals.items()],
        *[F.greatest(f"_m_{n}", f"_om_{c}").alias(n) for n, c in maxes.items()],
    )


def ranked(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """Number all rows 1..n by `order` [(column, descending)].

    The order must be total; nulls come first ascending and last descending. Rows
    are ranked in slices of the order, so they never meet in one task.
    """
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return ordered_scan(counted, [], list(order), sums={name: "_one"}).drop("_one")


def nearest_rank(
    values: DataFrame, keys: list[str], value: str, weight: str, share: float, name: str
) -> DataFrame:
    """Exact nearest-rank percentile per key from (keys, value, weight) rows.

    `values` holds one row per distinct (keys, value): the smallest value whose
    running weight reaches ceil(share * total weight).
    """
    scan = ordered_scan(values, keys, [value], sums={"_run": weight}, totals={"_all": weight})
    need = F.ceil(F.lit(share).cast("decimal(6,4)") * F.col("_all"))
    return scan.where(F.col("_run") >= need).groupBy(*keys).agg(F.min(value).alias(name))


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median per key (mean of the two middle values), and the number of rows as `n`."""
    weights = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    scan = ordered_scan(weights, keys, [value], sums={"_run": "_w"}, totals={"_all": "_w"})
    at = lambda rank: F.min(F.when(F.col("_run") >= rank, F.col(value)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    return scan.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name), F.max("_all").alias("n"))
