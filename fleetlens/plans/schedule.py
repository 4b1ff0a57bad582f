"""Schedule audit pack: cron jobs and timers that run too often, collide, or point at bad files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import mask as M
from fleetlens.operators.duplicates import same_schedule
from fleetlens.operators.skew import lookup

# Shorthands and what they stand for. Fixed values.
SHORTHANDS = {
    "daily": "0 0 * * *", "midnight": "0 0 * * *", "hourly": "0 * * * *", "weekly": "0 0 * * 0",
    "monthly": "0 0 1 * *", "yearly": "0 0 1 1 *", "annually": "0 0 1 1 *",
}


def normal_schedule(expression: Column) -> Column:
    """Shorthand (with or without @) resolved, spaces collapsed."""
    text = F.trim(F.regexp_replace(F.coalesce(expression, F.lit("")), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in SHORTHANDS.items() for x in kv])
    return F.coalesce(table[F.regexp_replace(F.lower(text), "^@", "")], text)


def script_path(command: Column) -> Column:
    """First word of a command, past NAME=value prefixes and out of its quotes."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(command, F.lit(""))), r"^(?:[A-Za-z0-9_]+=\S+\s+)*+", ""))
    quoted = F.coalesce(F.nullif(F.regexp_extract(bare, r'^"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"^'([^']*)'", 1), F.lit("")))
    return F.coalesce(quoted, F.regexp_replace(F.regexp_extract(bare, r"^\S*", 0), r"^['\"]+|['\"]+$", ""))


def findings(items: DataFrame, files: DataFrame) -> DataFrame:
    """(category, severity, source, item) of schedule items against a (path, mode) file listing.

    Items: source, type (cron or systemd), schedule, command_or_unit, on_calendar,
    timer_file, service_file.
    """
    c = F.col
    masked = items.withColumn("item", M.redact_text(c("command_or_unit"))).withColumn(
        "script", script_path(c("command_or_unit"))).withColumn("sched", F.trim(F.coalesce("schedule", F.lit(""))))
    looks_path = c("script").contains("/") | c("script").endswith(".sh") | c("script").endswith(".py")
    known = lookup(masked.withColumn("path", F.when(looks_path, c("script"))), files.select("path", "mode", F.lit(True).alias("_there")), "path", ["source", "item"])
    cron, timer = c("type") == "cron", c("type") == "systemd"
    every_minute = c("sched").startswith("* * * * *") | c("sched").startswith("*/1 * * * *")
    sub_hourly = F.coalesce("on_calendar", F.lit(False)) & (c("sched").contains("*:*:00") | c("sched").contains("*:00:00") | c("sched").contains("min"))
    there = F.coalesce("_there", F.lit(False))
    world, group = c("mode").bitwiseAND(2) != 0, c("mode").bitwiseAND(16) != 0
    unserved = timer & (F.coalesce("timer_file", F.lit("")) != "") & (F.coalesce("service_file", F.lit("")) == "")
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"))) for cond, cat, sev in (
            ((cron & every_minute) | (timer & sub_hourly), "Unusual Frequency", "Warning"),
            (unserved, "Mismatched State", "Critical"),
            (looks_path & ~there, "Missing Script", "High"),
            (looks_path & there & world, "Unsafe Executable Permissions", "Critical"),
            (looks_path & there & ~world & group, "Unsafe Executable Permissions", "Warning"))]))
    single = known.select("source", "item", F.explode(hits).alias("f")).select("f.category", "f.severity", "source", "item")
    shared = same_schedule(items.select("schedule", F.concat_ws(": ", "source", "command_or_unit").alias("job")), normal_schedule(c("schedule"))).select(
        F.lit("Conflicting Schedule / Overlap").alias("category"), F.lit("Warning").alias("severity"), F.lit("Multiple").alias("source"), c("schedule").alias("item"))
    return single.unionByName(shared)
