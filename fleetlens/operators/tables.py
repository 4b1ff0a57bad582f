"""Catalog and restore checks: row counts, charsets, index lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.skew import lookup
from fleetlens.operators.strong import condensed_levels


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows") for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def restore_findings(
    counts: DataFrame, previous: DataFrame, expected: list[str], key_tables: list[str], max_shrink_pct: float,
    backups: DataFrame | None = None, max_age_hours: float | None = None, min_bytes: int | None = None,
) -> DataFrame:
    """(tbl, rule, detail): missing, empty and shrunk tables, and (name, age_hours, bytes) backups too old or too small."""
    spark = counts.sparkSession
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "tbl string")
    rows = counts.join(previous.select("tbl", F.col("rows").alias("prev")), "tbl", "full_outer")
    pct = (F.col("prev") - F.coalesce("rows", F.lit(0))) * F.lit(100.0) / F.col("prev")
    missing = names(expected).join(counts, "tbl", "left_anti").select("tbl", F.lit("missing").alias("rule"), F.lit("").alias("detail"))
    empty = counts.where("rows = 0").join(F.broadcast(names(key_tables)), "tbl", "left_semi").select("tbl", F.lit("empty").alias("rule"), F.lit("").alias("detail"))
    shrunk = rows.where((F.col("prev") > 0) & (pct > max_shrink_pct)).select("tbl", F.lit("shrunk").alias("rule"), F.format_string("%d to %d rows", "prev", F.coalesce("rows", F.lit(0))).alias("detail"))
    out = missing.unionByName(empty).unionByName(shrunk)
    if backups is not None:
        hits = F.array_compact(F.array(
            F.when(F.lit(max_age_hours is not None) & (F.col("age_hours") > F.lit(max_age_hours)), F.lit("too_old")),
            F.when(F.lit(min_bytes is not None) & (F.col("bytes") < F.lit(min_bytes)), F.lit("too_small"))))
        out = out.unionByName(backups.select(F.col("name").alias("tbl"), F.explode(hits).alias("rule"), F.lit("").alias("detail")))
    return out


# Column types that carry a charset. Fixed values.
TEXT_TYPES = ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "enum", "set")
USER_CONTENT = r"(?i)(posts|postmeta|comments|commentmeta|users|usermeta|terms|options|content|messages)"


def _wrong(charset: Column, target: str) -> Column:
    return F.coalesce((charset != "") & (F.lower(charset) != target), F.lit(False))


def _off(collation: Column, target: str) -> Column:
    return F.coalesce((collation != "") & (F.lower(collation) != target), F.lit(False))


def charset_findings(
    tables: DataFrame, columns: DataFrame, databases: DataFrame | None = None, connection: DataFrame | None = None,
    charset: str = "utf8mb4", collation: str = "utf8mb4_unicode_ci", scope: list[str] | None = None,
) -> DataFrame:
    """(level, object, tbl, type, severity, current): objects off the target charset, or else off its collation.

    `databases` (name, charset, collation) is judged on full scans only;
    `connection` holds (name, value) of the connection's charset variables.
    """
    def judge(df: DataFrame, level: str, obj: Column, tbl: Column, bad: str | Column) -> DataFrame:
        kind = F.when(_wrong(F.col("charset"), charset), "charset").when(_off(F.col("collation"), collation), "collation")
        rows = df.select(F.lit(level).alias("level"), obj.alias("object"), tbl.alias("tbl"), kind.alias("type"),
                         F.col("charset").alias("_c"), F.col("collation").alias("_l"),
                         (bad if isinstance(bad, Column) else F.lit(bad)).alias("_bad")).where("type is not null")
        return rows.select("level", "object", "tbl", "type", F.when(F.col("type") == "charset", F.col("_bad")).otherwise("low").alias("severity"),
                           F.when(F.col("type") == "charset", F.col("_c")).otherwise(F.col("_l")).alias("current"))

    if scope is not None:
        tables, columns = tables.where(F.col("tbl").isin(scope)), columns.where(F.col("tbl").isin(scope))
    texts = columns.where(F.lower("data_type").isin(*TEXT_TYPES))
    out = judge(tables, "table", F.col("tbl"), F.col("tbl"), "medium").unionByName(judge(
        texts, "column", F.concat_ws(".", "tbl", "col"), F.col("tbl"), F.when(F.col("tbl").rlike(USER_CONTENT), "high").otherwise("medium")))
    null = F.lit(None).cast("string")
    if databases is not None and scope is None:
        out = out.unionByName(judge(databases, "database", F.col("name"), F.lit("(database)"), "medium"))
    if connection is not None:
        names = ("character_set_client", "character_set_connection", "character_set_results")
        vars_ = connection.where(F.col("name").isin(*names)).select("name", F.col("value").alias("charset"), null.alias("collation"))
        out = out.unionByName(judge(vars_, "connection", F.col("name"), F.lit("(connection)"), "high"))
    return out


def findings_by_table(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tbl").agg(
        F.count_if(F.col("type") == "charset").alias("charset"), F.count_if(F.col("type") == "collation").alias("collation"))


def tables_to_convert(tables: DataFrame, columns: DataFrame, charset: str = "utf8mb4") -> DataFrame:
    found = charset_findings(tables, columns, charset=charset)
    return found.where("type = 'charset'").select("tbl").distinct()


def index_overflows(tables: DataFrame, columns: DataFrame, index_parts: DataFrame, charset: str = "utf8mb4") -> DataFrame:
    """Index parts (tbl, index_name, col, sub_part) that outgrow the byte limit once their table is converted."""
    width = 4 if charset == "utf8mb4" else 3
    limit = F.when(F.lower(F.coalesce("row_format", F.lit(""))).isin("compact", "redundant"), 767).otherwise(3072)
    targets = tables.join(tables_to_convert(tables, columns, charset), "tbl", "left_semi").select("tbl", limit.alias("byte_limit"))
    sized = columns.where(F.lower("data_type").isin("varchar", "char")).select("tbl", "col", "length")
    parts = index_parts.join(sized, ["tbl", "col"])
    joined = lookup(parts, targets, "tbl", ["index_name", "col"], how="inner")
    return joined.select("tbl", "index_name", "col", (F.coalesce("sub_part", "length").cast("bigint") * width).alias("bytes"), "byte_limit").where(
        F.col("bytes") > F.col("byte_limit"))


def conversion_ddl(levels: DataFrame, charset: str = "utf8mb4", collation: str = "utf8mb4_unicode_ci") -> DataFrame:
    """ALTER statements for (node, level) tables, parents first; unordered (cyclic) tables come last."""
    return levels.select(
        F.coalesce("level", F.lit(2 ** 31)).alias("step"), F.col("node").alias("tbl"),
        F.concat(F.lit("ALTER TABLE `"), "node", F.lit(f"` CONVERT TO CHARACTER SET {charset} COLLATE {collation};")).alias("statement"))


def conversion_plan(
    tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame, charset: str = "utf8mb4", collation: str = "utf8mb4_unicode_ci",
) -> DataFrame:
    """(step, unit, n_tables, tbl, statement): the tables off the target charset in the order of their foreign keys.

    A table follows the tables that its foreign keys (tbl, ref_tbl) name. Tables that
    refer to each other in a ring are one unit, called after its smallest table, and
    convert in one step; n_tables is the unit's size. Keys to tables that need no
    conversion, to unknown tables and to the table itself make no order.
    """
    todo = tables_to_convert(tables, columns, charset).select(F.col("tbl").alias("node"))
    keys = foreign_keys.select(F.col("ref_tbl").alias("src"), F.col("tbl").alias("dst"))
    levels = condensed_levels(todo, keys).select(F.col("level").alias("step"), F.col("component").alias("unit"), F.col("node").alias("tbl"))
    sizes = levels.groupBy("unit").agg(F.count("*").alias("n_tables"))
    name = F.replace("tbl", F.lit("`"), F.lit("``"))
    return levels.join(sizes, "unit").select(
        "step", "unit", "n_tables", "tbl",
        F.concat(F.lit("ALTER TABLE `"), name, F.lit(f"` CONVERT TO CHARACTER SET {charset} COLLATE {collation}")).alias("statement"))


def conversion_script(plan: DataFrame, databases: DataFrame | None = None, charset: str = "utf8mb4", collation: str = "utf8mb4_unicode_ci") -> DataFrame:
    """(phase, step, unit, tbl, statement) to be run in the order of the first four columns.

    Key checks go off (phase 0), databases (name, charset) off the target get it as
    their default (1), tables convert (2), key checks come back (3). The checks are
    left alone when no table converts.
    """
    none, zero = F.lit("").alias("unit"), F.lit(0).cast("bigint").alias("step")
    some = plan.limit(1)
    switch = lambda phase, on: some.select(
        F.lit(phase).alias("phase"), zero, none, F.lit("").alias("tbl"), F.lit(f"SET FOREIGN_KEY_CHECKS={on}").alias("statement"))
    out = plan.select(F.lit(2).alias("phase"), "step", "unit", "tbl", "statement").unionByName(switch(0, 0)).unionByName(switch(3, 1))
    if databases is None:
        return out
    name = F.replace("name", F.lit("`"), F.lit("``"))
    return out.unionByName(databases.where(_wrong(F.col("charset"), charset)).select(
        F.lit(1).alias("phase"), zero, none, F.col("name").alias("tbl"),
        F.concat(F.lit("ALTER DATABASE `"), name, F.lit(f"` CHARACTER SET {charset} COLLATE {collation}")).alias("statement")))
