"""Groups of rows that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.skew import lookup
from fleetlens.session import staged


def duplicate_groups(rows: DataFrame, key: Column, member: str, min_size: int = 2) -> DataFrame:
    """One row per key shared by several rows: size, first and last member. Blank keys do not count.

    Groups are keyed by a hash of the key, so neither the shuffle nor later
    joins carry whole texts.
    """
    keyed = rows.select(F.sha2(F.nullif(key, F.lit("")), 256).alias("group_id"), F.col(member).alias("_m"))
    return (
        keyed.groupBy("group_id")
        .agg(F.count("*").alias("n"), F.min("_m").alias("first_member"), F.max("_m").alias("last_member"))
        .where(F.col("group_id").isNotNull() & (F.col("n") >= min_size))
    )


def duplicate_members(rows: DataFrame, key: Column, member: str, min_size: int = 2) -> DataFrame:
    """Every member of every duplicate group with its group and the number of others.

    The others themselves are the group's rows: one row per member instead of a
    list of all others per member, which would be quadratic.
    """
    # The texts are read and hashed once; what is grouped and joined is (member, hash).
    hashed = staged(rows.select(F.col(member), F.sha2(F.nullif(key, F.lit("")), 256).alias("group_id")), "hashes")
    keyed = hashed.where(F.col("group_id").isNotNull())
    sizes = keyed.groupBy("group_id").agg(
        F.count("*").alias("n"), F.min(member).alias("first_member")
    ).where(F.col("n") >= min_size)
    return lookup(keyed, sizes, "group_id", [member], how="inner", base=hashed, weight="n")


def collisions(entries: DataFrame, source: Column, target: Column, status: Column) -> DataFrame:
    """Sources that map to several (target, status) pairs."""
    return (
        entries.select(source.alias("source"), F.coalesce(target, F.lit("")).alias("t"), status.alias("s"))
        .groupBy("source", "t", "s").agg(F.count("*").alias("n"))
        .groupBy("source").agg(F.count("*").alias("n_targets"), F.sum("n").alias("n_entries"))
        .where(F.col("n_targets") > 1)
    )


def same_schedule(jobs: DataFrame, expression: Column) -> DataFrame:
    """Schedule expressions shared by more than one job."""
    return (
        jobs.select(expression.alias("schedule"), F.col("job"))
        .where((F.col("schedule") != "") & (F.col("schedule") != "N/A"))
        .groupBy("schedule").agg(F.count("*").alias("n_jobs"), F.min("job").alias("first_job"))
        .where(F.col("n_jobs") > 1)
    )
