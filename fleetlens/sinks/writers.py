"""Writers: findings tables and reports, run histories, snapshots, redirect rules, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.schemas import ENVELOPE


def with_healthy(pages: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Page columns beside each finding; a page without findings keeps one row of rule None."""
    mine = findings.select(F.col("entity_id").alias(key), "rule", "severity", "score", "message")
    return pages.join(mine, key, "left").select(
        *pages.columns, F.coalesce("rule", F.lit("None")).alias("rule"), F.coalesce("severity", F.lit("None")).alias("severity"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("message", F.lit("Healthy")).alias("message"))


def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV with doubled quotes."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings stored by pack, so that choosing packs prunes folders."""
    findings.write.mode("overwrite").partitionBy("pack").parquet(path)


def nested_report(pages: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """One row per page with its distinct findings as a sorted array, each with the times it was found.

    A page without findings has a null array. A message that repeats without end
    stays one element, so a row grows with a page's distinct findings only.
    """
    counted = findings.groupBy(F.col("entity_id").alias(key), "severity", F.coalesce("score", F.lit(0)).alias("score"), "rule", "message").agg(
        F.count("*").alias("times"))
    item = F.struct((-F.col("score")).alias("order"), "rule", "severity", "score", "message", "times")
    grouped = counted.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda f: f.dropFields("order")).alias("findings"))
    return pages.join(grouped, key, "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_run(run: DataFrame, path: str) -> None:
    """Append one run's compact rows to the history, by run date."""
    run.write.mode("append").partitionBy("run_date").parquet(path)


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write a snapshot under its own run id; the committer makes it appear whole or not at all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path) if "run_id" in df.columns else (
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def redirect_rules(redirects: DataFrame) -> DataFrame:
    """(source, apache, nginx_rewrite, nginx_map) rule texts; missing targets get none."""
    c = F.col
    rows = redirects.where((F.coalesce("source", F.lit("")) != "") & (c("classification") != "missing")).select(
        "source", "target", "status", c("source").contains("?").alias("q"), F.substring_index("source", "?", 1).alias("path"),
        F.regexp_extract("source", r"(?s)\?(.*)$", 1).alias("query"))
    gone = c("status") == 410
    end = F.when(c("target").contains("?"), "").otherwise("?")
    status = c("status").cast("string")
    apache = F.when(gone, F.concat(F.lit("Redirect 410 "), _quoted(c("path")))).when(
        c("q"), F.concat(F.lit("RewriteCond %{QUERY_STRING} ^"), _escaped(c("query")), F.lit("$\nRewriteRule ^"), _escaped(F.regexp_replace("path", "^/", "")),
                         F.lit("$ "), c("target"), end, F.lit(" [R="), status, F.lit(",L]"))).otherwise(
        F.concat(F.lit("Redirect "), status, F.lit(" "), _quoted(c("path")), F.lit(" "), _quoted(c("target"))))
    exact = F.concat(F.lit("if ($request_uri = "), _quoted(c("source")), F.lit(") {\n    return "))
    plain = ~c("q") & ~c("source").contains(" ") & ~c("source").contains('"')
    nginx = F.when(gone & c("q"), F.concat(exact, F.lit("410;\n}"))).when(
        gone, F.concat(F.lit("rewrite ^"), _escaped(c("path")), F.lit('$ "" permanent;'))).when(
        plain, F.concat(F.lit("rewrite ^"), _escaped(c("path")), F.lit("$ "), c("target"), F.when(c("status") == 301, " permanent;").otherwise(" redirect;"))).otherwise(
        F.concat(exact, status, F.lit(" "), c("target"), end, F.lit(";\n}")))
    line = F.concat(F.lit("    "), _quoted(c("source")), F.lit(" "), _quoted(F.when(gone, "gone").otherwise(c("target"))), F.lit(";"))
    return rows.select("source", apache.alias("apache"), nginx.alias("nginx_rewrite"), line.alias("nginx_map"))


def write_rules(rules: DataFrame, kind: str, path: str) -> None:
    rules.select(F.col(kind).alias("value")).write.mode("overwrite").text(path)


# Fixed values of the contract.
CONTRACT_VERSION = "1.0.0"
STATUSES = ("success", "failure", "error")


def envelope(hits: DataFrame, tool: str, version: str, started: str, ended: str) -> DataFrame:
    """One result envelope from check results (path, severity)."""
    total = F.count("*")
    failed, warned = F.count_if(F.col("severity") == "fail"), F.count_if(F.col("severity") == "warn")
    return hits.agg(total.alias("total"), failed.alias("failed"), warned.alias("warnings")).select(
        F.lit(CONTRACT_VERSION).alias("contract_version"), F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version")).alias("tool"),
        F.when(F.col("failed") > 0, "failure").otherwise("success").alias("status"),
        F.struct("total", (F.col("total") - F.col("failed")).alias("passed"), "failed", "warnings").alias("summary"),
        *[F.array().cast("array<string>").alias(n) for n in ("results", "warnings", "errors")],
        F.struct(F.lit(started).alias("start_time"), F.lit(ended).alias("end_time"),
                 (F.unix_millis(F.lit(ended).cast("timestamp")) - F.unix_millis(F.lit(started).cast("timestamp"))).alias("duration_ms")).alias("timing"),
        F.array().cast("array<string>").alias("artifacts"))


def envelope_violations(texts: DataFrame) -> DataFrame:
    """(source, field, problem) of JSON envelopes (source, text) that break the contract."""
    parsed = texts.select("source", F.from_json("text", ENVELOPE).alias("e"), F.try_parse_json("text").alias("v"))
    required = [f.name for f in ENVELOPE.fields]
    missing = [F.when(F.col("v").isNotNull() & F.col(f"e.{n}").isNull(), F.struct(F.lit(n).alias("field"), F.lit("missing").alias("problem"))) for n in required]
    versions = F.when(F.col("e.contract_version") != CONTRACT_VERSION, F.struct(F.lit("contract_version").alias("field"), F.lit("not allowed").alias("problem")))
    bad = F.when(F.col("e.status").isNotNull() & ~F.col("e.status").isin(*STATUSES), F.struct(F.lit("status").alias("field"), F.lit("not allowed").alias("problem")))
    broken = F.when(F.col("v").isNull(), F.struct(F.lit("").alias("field"), F.lit("not JSON").alias("problem")))
    return parsed.select("source", F.explode(F.array_compact(F.array(*missing, versions, bad, broken))).alias("p")).select("source", "p.field", "p.problem")
