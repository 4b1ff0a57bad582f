"""Line-oriented formats: slow logs, patch logs, env files, crontabs, gettext catalogs.

Each parser takes (file, pos, line) rows. State that runs over lines is an
ordered scan, so one huge file is cut into slices like any other hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.operators.disk import ignored
from fleetlens.operators.ordered import ordered_scan


def read_lines(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    """(file, pos, line) of text files; pos grows along each file.

    Splits of one file keep their order through the split's start offset, so a
    large file is read in parallel.
    """
    meta = spark.read.option("lineSep", line_sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))
    # Within one split the generated ids grow line by line; the block start orders the splits.
    return meta.select("file", (F.col("block") * F.lit(1 << 20) + F.col("n") % F.lit(1 << 33)).alias("pos"), "line")


# Line format of the slow log. Fixed value.
STATS = r"Query_time:\s*([\d.]+)\s+Lock_time:\s*([\d.]+)\s+Rows_sent:\s*(\d+)\s+Rows_examined:\s*(\d+)"


def slow_log(lines: DataFrame) -> DataFrame:
    """Statement events of a slow log: (file, seq, time, user_host, query_ms, lock_ms, rows_sent, rows_examined, sql).

    An entry opens at the first header line after SQL text, or at a new time
    stamp when the open entry already has its statistics. Entries without
    statistics or without SQL are dropped.
    """
    line = F.col("line")
    head = line.startswith("#")
    time, user, stats = line.startswith("# Time:"), line.startswith("# User@Host:"), head & line.rlike(STATS)
    trimmed = F.trim(line)
    admin = trimmed.rlike(r"(?i)^(SET timestamp=|use\s+\S+;?$)") | line.rlike(r"started with:|^Tcp port:|^Time\s+Id\s+Command")
    sql = ~head & (trimmed != "") & ~admin
    marked = lines.withColumn("mark", F.when(sql, "sql").when(stats, "stats").when(time | user, "head"))
    scan = ordered_scan(marked, ["file"], ["pos"], carry_before={"was": "mark"})
    opens = head & (F.col("was").isNull() | (F.col("was") == "sql") | (time & (F.col("was") == "stats")))
    numbered = ordered_scan(scan.withColumn("open", opens.cast("bigint")), ["file"], ["pos"], sums={"rec": "open"})
    kept = numbered.where((F.col("rec") > 0) & F.col("mark").isNotNull())
    last = lambda value, cond: F.max_by(value, F.when(cond, F.col("pos")))
    num = lambda i: last(F.regexp_extract(line, STATS, i), stats)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(sql, F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    entries = kept.groupBy("file", "rec").agg(
        F.min("pos").alias("seq"), last(F.trim(F.substr(line, F.lit(8))), time).alias("time"), last(F.trim(F.substr(line, F.lit(13))), user).alias("user_host"),
        (num(1).cast("double") * 1000).alias("query_ms"), (num(2).cast("double") * 1000).alias("lock_ms"),
        num(3).cast("bigint").alias("rows_sent"), num(4).cast("bigint").alias("rows_examined"), F.trim(text).alias("sql"))
    leftover = F.col("sql").rlike(r"(?i)^(quit|flush\s|# )")
    return entries.where(F.col("query_ms").isNotNull() & (F.col("sql") != "") & ~leftover).drop("rec")


def added_lines(lines: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Lines a patch log adds: (file, line, text, location, commit) with their number in the new file."""
    line = F.col("line")
    commit = F.regexp_extract(line, r"^commit ([0-9a-f]{7,40})", 1)
    target = F.regexp_extract(line, r"^\+\+\+ b/(.+)$", 1)
    start = F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    is_commit, is_plus3, is_hunk = commit != "", line.startswith("+++"), start != ""
    named = F.when((target != "") & ~ignored(target, list(ignore)), target)
    marked = lines.select(
        F.col("file").alias("log"), "pos", "line", F.when(is_commit, F.substring(commit, 1, 8)).alias("c"),
        F.when(is_commit | is_plus3, F.struct(F.when(~is_commit, named).alias("name"))).alias("f"), F.when(is_hunk, start.cast("bigint")).alias("h"),
        (~is_commit & ~is_plus3 & ~is_hunk & (line.startswith("+") | line.startswith(" "))).cast("bigint").alias("step"))
    scan = ordered_scan(marked, ["log"], ["pos"], sums={"n": "step"}, carry={"commit": "c", "at": "f"})
    scan = ordered_scan(scan.withColumn("base", F.col("h") - F.col("n")), ["log"], ["pos"], carry={"from": "base"})
    added = line.startswith("+") & ~is_plus3 & (F.col("step") == 1) & F.col("at.name").isNotNull()
    return scan.where(added).select(
        F.col("at.name").alias("file"), (F.col("from") + F.col("n") - 1).alias("line"), F.substr(line, F.lit(2)).alias("text"),
        F.lit("history").alias("location"), "commit", F.col("pos").alias("seq"))


def env_values(lines: DataFrame) -> DataFrame:
    """(file, key, value, seq) of env files; quotes and inline comments removed."""
    text = F.regexp_replace(F.trim("line"), r"^export ", "")
    value = F.trim(F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1))
    quoted = value.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(value) >= 2)
    clean = F.when(quoted, F.regexp_replace(value, r"(?s)^.(.*).$", "$1")).otherwise(F.trim(F.regexp_replace(value, r"(?s)\s#.*$", "")))
    return lines.where(~F.trim("line").rlike(r"^#") & F.trim(text).rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\s*=")).select(
        "file", F.trim(F.regexp_extract(F.trim(text), r"^([^=]+)=", 1)).alias("key"), clean.alias("value"), F.col("pos").alias("seq"))


def cron_items(lines: DataFrame, with_user: bool) -> DataFrame:
    """Schedule items of crontab lines; `with_user` is the system form with an owner column."""
    text = F.trim("line")
    short = text.startswith("@")
    owner = r"(\S+)\s+" if with_user else r"()"
    pattern = r"^((?:\S+\s+){4}\S+)\s+" + owner + r"(.+)$"
    at_pattern = r"^(@\S+)\s+" + owner + r"(.+)$"
    part = lambda i: F.when(short, F.regexp_extract(text, at_pattern, i)).otherwise(F.regexp_extract(text, pattern, i))
    ok = F.when(short, text.rlike(at_pattern)).otherwise(text.rlike(pattern))
    entry = ~text.rlike(r"^(#|$)") & ~text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*=") & ok
    return lines.where(entry).select(
        F.col("file").alias("source"), F.lit("cron").alias("type"), F.regexp_replace(part(1), r"\s+", " ").alias("schedule"), part(2).alias("owner"),
        part(3).alias("command_or_unit"), F.lit(False).alias("on_calendar"), F.lit(None).cast("string").alias("timer_file"), F.lit(None).cast("string").alias("service_file"))


def unit_items(units: DataFrame) -> DataFrame:
    """Schedule items of systemd timers and services: (file, text, seq) whole files; the first directory wins per name."""
    name = F.substring_index("file", "/", -1)
    first = units.groupBy(name.alias("name")).agg(F.min_by("text", "seq").alias("text"), F.min_by("file", "seq").alias("file"))
    field = lambda section, key: F.trim(F.regexp_extract("text", rf"(?s)\[{section}\](?:(?!\n\[).)*?\n\s*{key}\s*=\s*([^\n]*)", 1))
    timers = first.where(F.col("name").endswith(".timer")).select(
        F.col("file").alias("source"), F.col("name").alias("timer_file"), F.coalesce(F.nullif(field("Timer", "OnCalendar"), F.lit("")), F.lit("N/A")).alias("schedule"),
        (field("Timer", "OnCalendar") != "").alias("on_calendar"),
        F.coalesce(F.nullif(field("Timer", "Unit"), F.lit("")), F.regexp_replace("name", r"\.timer$", ".service")).alias("wanted"))
    services = first.where(F.col("name").endswith(".service")).select(
        F.col("name").alias("wanted"), F.col("name").alias("service_file"), field("Service", "ExecStart").alias("cmd"), field("Service", "User").alias("owner"))
    return timers.join(services, "wanted", "left").select(
        "source", F.lit("systemd").alias("type"), "schedule", "owner", F.coalesce("cmd", "wanted").alias("command_or_unit"), "on_calendar", "timer_file", "service_file")


def _unescape(text: Column) -> Column:
    for raw, char in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(raw), F.lit(char))
    return text


def gettext(lines: DataFrame) -> DataFrame:
    """(file, id, text) of PO catalogs; continued strings are joined, the header entry is left out."""
    text = F.trim("line")
    quoted = F.regexp_extract(text, r'^(?:msgid|msgstr)?\s*"(.*)"$', 1)
    kind = F.when(text.startswith("msgid"), "id").when(text.startswith("msgstr"), "str").when(~text.startswith('"'), "other")
    marked = lines.where(text != "").select("file", "pos", quoted.alias("q"), kind.alias("k"), text.startswith("msgid").cast("bigint").alias("open"))
    scan = ordered_scan(marked, ["file"], ["pos"], sums={"rec": "open"}, carry={"part": "k"}).where("rec > 0")
    joined = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("pos", "q")))), lambda s: s["q"]), "")
    return scan.groupBy("file", "rec").agg(joined("id").alias("id"), joined("str").alias("text")).where("id <> ''").select(
        "file", _unescape(F.col("id")).alias("id"), _unescape(F.col("text")).alias("text"))
