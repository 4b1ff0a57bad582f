"""Statement digests: aggregation, ranking, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import sqltext
from fleetlens.functions.text import round_half_up
from fleetlens.operators.ordered import ordered_scan, ranked
from fleetlens.session import staged

PICOS_PER_MS = 1_000_000_000
EXACT = "decimal(38,6)"


def statement_digests(log: DataFrame, min_total_ms: float = 0.0) -> DataFrame:
    """One ranked row per digest from (seq, sql, query_ms, rows_sent, rows_examined).

    Rows collapse to one per (digest, time) before the first shuffle; the exact
    nearest-rank p95 then comes from a running weight over those, so one digest
    that owns most of the log still spreads over many tasks.
    """
    text = sqltext.normalize(F.col("sql"))
    collapsed = (
        log.select("seq", "sql", "query_ms", "rows_sent", "rows_examined", text.alias("normalized"))
        .withColumn("digest", sqltext.digest_id(F.col("normalized")))
        .groupBy("digest", "query_ms")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("rows_sent", F.lit(0))).alias("sent"),
            F.sum(F.coalesce("rows_examined", F.lit(0))).alias("examined"),
            F.min("seq").alias("first_seq"),
            F.min_by("sql", "seq").alias("sample"),
            F.max("normalized").alias("normalized"),
        )
        # Below the aggregate this filter would run the whole digest chain a second time.
        .where(F.col("normalized") != "")
    )
    scan = ordered_scan(collapsed, ["digest"], ["query_ms"], sums={"_run": "n"}, totals={"_all": "n"})
    reached = F.col("_run") >= F.ceil(F.col("_all") * F.lit(95) / F.lit(100))
    ms = F.col("query_ms").cast(EXACT)
    groups = scan.groupBy("digest").agg(
        F.first("normalized").alias("normalized"),
        F.min_by("sample", "first_seq").alias("sample"),
        F.sum("n").alias("count"),
        F.sum((ms * F.col("n")).cast(EXACT)).cast("double").alias("_total"),
        F.min(F.when(reached, F.col("query_ms"))).alias("_p95"),
        F.sum("examined").alias("rows_examined"),
        F.sum("sent").alias("rows_sent"),
    )
    return _finish(groups, F.col("_total") / F.col("count"), min_total_ms)


def _finish(groups: DataFrame, mean: Column, min_total_ms: float) -> DataFrame:
    ratio = F.col("rows_examined") / F.greatest(F.col("rows_sent"), F.lit(1))
    out = groups.select(
        "digest", "normalized", "sample", "count",
        round_half_up(F.col("_total"), 1).alias("total_ms"),
        round_half_up(mean, 1).alias("mean_ms"),
        round_half_up(F.col("_p95"), 1).alias("p95_ms"),
        "rows_examined", "rows_sent",
        F.floor(ratio + 0.5).cast("bigint").alias("examine_ratio"),
    ).where(F.col("total_ms") >= min_total_ms)
    return ranked(out, [("total_ms", True), ("digest", False)])


def from_perf_digests(rows: DataFrame, min_total_ms: float = 0.0) -> DataFrame:
    """Ranked digests from already aggregated server statistics in picoseconds."""
    count = F.col("COUNT_STAR")
    total = F.coalesce("SUM_TIMER_WAIT", F.lit(0.0)) / PICOS_PER_MS
    groups = (
        rows.withColumn("normalized", sqltext.normalize(F.col("DIGEST_TEXT")))
        .where((F.col("normalized") != "") & (count > 0))
        .select(
            sqltext.digest_id(F.col("normalized")).alias("digest"), "normalized",
            F.col("normalized").alias("sample"), count.alias("count"), total.alias("_total"),
            F.coalesce(F.col("QUANTILE_95") / PICOS_PER_MS, total / count).alias("_p95"),
            F.coalesce("SUM_ROWS_EXAMINED", F.lit(0)).alias("rows_examined"),
            F.coalesce("SUM_ROWS_SENT", F.lit(0)).alias("rows_sent"),
        )
    )
    return _finish(groups, F.col("_total") / F.col("count"), min_total_ms)


def index_candidates(digests: DataFrame) -> DataFrame:
    """digest -> candidate index (table, columns, DDL); digests without one are left out."""
    # One column per step: a step that several later ones read is computed once. The
    # rows are dropped by inline, not by a filter, which would be pushed down
    # through the steps and copy them.
    return (
        digests.withColumn("_refs", sqltext.table_refs(F.col("normalized")))
        .withColumn("_preds", sqltext.usable_predicates(sqltext.where_columns(F.col("normalized"), F.col("_refs"))))
        .withColumn("_orders", sqltext.order_columns(F.col("normalized"), F.col("_refs")))
        .withColumn("tbl", sqltext.target_table(F.col("_preds")))
        .withColumn("cols", sqltext.index_columns(F.col("_preds"), F.col("_orders"), F.col("tbl")))
        .select("digest", F.inline(F.when(
            F.col("tbl").isNotNull() & (F.size("cols") > 0), F.array(F.struct("tbl", "cols"))
        )))
        .select("digest", "tbl", "cols", sqltext.index_ddl(F.col("tbl"), F.col("cols")).alias("ddl"))
    )


def covered_candidates(candidates: DataFrame, indexes: DataFrame) -> DataFrame:
    """Candidates whose columns are a prefix of an index (tbl, columns) of the same table.

    The prefix test is an equi-join: every prefix of every index is one key.
    """
    lower = lambda c: F.transform(c, F.lower)
    prefixes = indexes.select(
        F.lower("tbl").alias("_t"),
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size("columns")),
            lambda n: F.array_join(F.slice(lower(F.col("columns")), F.lit(1), n), ","),
        )).alias("_p"),
    ).distinct()
    return candidates.join(
        prefixes,
        (F.lower(candidates.tbl) == prefixes["_t"])
        & (F.array_join(lower(candidates.cols), ",") == prefixes["_p"]),
        "left_semi",
    )


def explain_verdicts(rows: DataFrame) -> DataFrame:
    """Per digest: flags of its EXPLAIN rows (digest, seq, type, key, extra, tbl) and full_scan."""
    flags = sqltext.explain_flags(F.col("type"), F.col("key"), F.col("extra"), F.col("tbl"))
    return (
        rows.select("digest", F.explode(flags).alias("flag"))
        .groupBy("digest")
        .agg(
            F.array_sort(F.collect_set("flag")).alias("flags"),
            F.bool_or(F.col("flag").startswith("full table scan")).alias("full_scan"),
        )
    )


def diagnosis(digests: DataFrame, explain: DataFrame | None = None, indexes: DataFrame | None = None,
              ratio_warn: int = 100, sure_ratio: int = 1000) -> DataFrame:
    """Per digest: flags, the suggested index (tbl, cols, ddl) if none covers it, and how sure the suggestion is.

    `explain` holds EXPLAIN rows as for `explain_verdicts`, `indexes` the existing
    ones as for `covered_candidates`. A digest whose sample has no literals cannot
    have been explained; its rows are ignored. Without `explain` a suggestion is
    sure from `sure_ratio` examined rows per sent row on, with it when a table is
    scanned whole.
    """
    bare = (F.col("sample") == F.col("normalized")) & F.col("sample").rlike(r"(^|[\s(=,])\?")
    found = staged(index_candidates(digests), "candidates")
    if indexes is not None:
        covered = covered_candidates(found, indexes).select("digest", F.lit(True).alias("redundant"))
        found = found.join(covered, "digest", "left")
    else:
        found = found.withColumn("redundant", F.lit(False))
    rows = digests.select("digest", "normalized", "examine_ratio", "rows_examined", bare.alias("parameterized")).join(found, "digest", "left")
    if explain is not None:
        rows = rows.join(explain_verdicts(explain), "digest", "left")
        shown = F.when(~F.col("parameterized"), F.col("flags"))
        sure = ~F.col("parameterized") & F.coalesce("full_scan", F.lit(False))
    else:
        shown, sure = F.lit(None).cast("array<string>"), F.col("examine_ratio") >= sure_ratio
    smell = F.when((F.col("examine_ratio") >= ratio_warn) & (F.col("rows_examined") > 0),
                   F.array(F.concat(F.lit("reads "), "examine_ratio", F.lit(" rows for each row sent"))))
    none, redundant = F.array().cast("array<string>"), F.coalesce("redundant", F.lit(False))
    offered = F.col("tbl").isNotNull() & ~redundant
    return rows.select(
        "digest", F.concat(F.coalesce(shown, none), F.coalesce(smell, none)).alias("flags"), "parameterized", redundant.alias("covered"),
        *[F.when(offered, F.col(c)).alias(c) for c in ("tbl", "cols", "ddl")],
        F.when(offered, F.when(sure, "high").otherwise("to check")).alias("confidence"))


def payload_bloat(options: DataFrame, warn_bytes: int = 800 * 1024) -> DataFrame:
    """One row: total bytes and count of (name, value) payloads against a threshold."""
    size = F.octet_length("value")
    return options.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.count("*").alias("n"),
    ).select("total_bytes", "n", (F.col("total_bytes") >= warn_bytes).alias("bloated"))


def largest_payloads(options: DataFrame, top: int = 10) -> DataFrame:
    return (
        options.select("name", F.octet_length("value").alias("bytes"))
        .orderBy(F.desc("bytes"), "name").limit(top)
    )
