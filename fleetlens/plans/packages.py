"""Package packs: extension policy and dependency updates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import version as V
from fleetlens.operators.findings import Rule, evaluate
from fleetlens.operators.ordered import ordered_scan
from fleetlens.operators.skew import lookup

# Severity per policy rule. Fixed values.
POLICY_SEVERITY = {
    "inactive": "medium", "unknown_version": "medium", "update_available": "high",
    "disallowed": "critical", "core_outdated": "critical", "not_allowed": "high",
}


@dataclass(frozen=True)
class Policy:
    flag_inactive: bool = True
    flag_unknown_version: bool = True
    flag_update_available: bool = True
    min_core_version: str | None = None
    allowed_plugins: tuple[str, ...] = ()
    disallowed_plugins: tuple[str, ...] = ()
    allowed_themes: tuple[str, ...] = ()
    disallowed_themes: tuple[str, ...] = ()
    severities: dict[str, str] = field(default_factory=dict)


def policy_findings(inventory: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Findings of (site, ext_type, name, status, update, version, update_version) rows; one scan.

    ext_type is core, plugin, theme or mu-plugin; mu-plugins follow the plugin lists.
    """
    kind, name, version = F.col("ext_type"), F.col("name"), F.col("version")
    plugin, theme, core, mu = kind.isin("plugin", "mu-plugin"), kind == "theme", kind == "core", kind == "mu-plugin"
    known = F.coalesce(version, F.lit("")) != ""
    severity = {**POLICY_SEVERITY, **policy.severities}

    def listed(plugins: tuple[str, ...], themes: tuple[str, ...]) -> Column:
        return (plugin & name.isin(*plugins)) | (theme & name.isin(*themes))

    restricted = (plugin & F.lit(bool(policy.allowed_plugins))) | (theme & F.lit(bool(policy.allowed_themes)))

    def rule(rule_name: str, when: Column, message: Column) -> Rule:
        return Rule(rule_name, severity[rule_name], F.coalesce(when, F.lit(False)), message, location=F.col("site"),
                    after=F.col("update_version"), before=version)

    below = V.less_than(version, F.lit(policy.min_core_version)) if policy.min_core_version else F.lit(False)
    newer = F.when(core, V.less_than(version, F.col("update_version"))).otherwise(F.col("update") == "available")
    return evaluate(inventory, "policy", "extension", F.concat_ws(":", kind, name), [
        rule("core_outdated", core & known & below, F.concat(version, F.lit(" below "), F.lit(policy.min_core_version or ""))),
        rule("unknown_version", F.lit(policy.flag_unknown_version) & ~core & ~known, F.concat(name, F.lit(" has no version"))),
        rule("disallowed", listed(policy.disallowed_plugins, policy.disallowed_themes), F.concat(name, F.lit(" is denied"))),
        rule("not_allowed", restricted & ~listed(policy.allowed_plugins, policy.allowed_themes), F.concat(name, F.lit(" is not on the allow list"))),
        rule("inactive", F.lit(policy.flag_inactive) & kind.isin("plugin", "theme") & (F.col("status") == "inactive"), F.concat(name, F.lit(" is inactive"))),
        rule("update_available", F.lit(policy.flag_update_available) & ~mu & newer,
             F.concat(name, F.lit(" has an update to "), F.coalesce("update_version", F.lit("a newer version")))),
    ])


def inventory_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("ext_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "inactive").alias("inactive"), F.count_if(F.col("update") == "available").alias("updates"))


SEVERITY_OF_JUMP = {"major": "major", "minor": "minor", "patch": "patch", "unknown": "minor"}


def dependency_rows(rows: DataFrame) -> DataFrame:
    """Add the version jump to (project, type, package, current, latest)."""
    return rows.withColumn("jump", V.jump(F.col("current"), F.col("latest")))


def advisory_counts(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Add `advisories`: how many of its package's (package, affected_below) advisories hit a row.

    No bound or no current version counts as affected; otherwise the current
    version must be below the bound. Counted by one ordered scan over bounds and
    versions, so a popular package with many advisories makes no pairs.
    """
    keyed = rows.withColumn("_v", V.semver(F.col("current"))).withColumn(
        "_id", F.xxhash64("project", "type", "package"))
    bounds = advisories.withColumn("_v", V.semver(F.col("affected_below")))
    open_ended = advisories.groupBy("package").agg(
        F.count_if(F.col("affected_below").isNull()).alias("_open"), F.count("*").alias("_every"))
    points = keyed.select("package", "_v").where("_v is not null").distinct().select(
        "package", "_v", F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_n"))
    marks = bounds.where("_v is not null").groupBy("package", "_v").agg(F.count("*").alias("_n")).select(
        "package", "_v", F.lit(0).alias("_kind"), "_n")
    above = ordered_scan(points.unionByName(marks), ["package"], ["_v", "_kind"], sums={"_above": "_n"}, reverse=True).where(
        "_kind = 1").select(F.xxhash64("package", "_v").alias("_k"), F.col("_above"))
    out = lookup(keyed, open_ended, "package", ["_id"])
    out = lookup(out.withColumn("_k", F.xxhash64("package", "_v")), above, "_k", ["_id"])
    hit = F.when(F.col("current").isNull(), F.col("_every")).otherwise(F.col("_open") + F.coalesce("_above", F.lit(0)))
    return out.select(*rows.columns, F.coalesce(hit, F.lit(0)).alias("advisories"))


def audit_rows(outdated: DataFrame, audit: DataFrame) -> DataFrame:
    """Outer form: an advisory for a package without an outdated row creates one (no versions known)."""
    per_package = audit.groupBy("project", "type", "package").agg(F.count("*").alias("_n"))
    return outdated.join(per_package, ["project", "type", "package"], "full_outer").withColumn(
        "advisories", F.coalesce("_n", F.lit(0))).drop("_n")


def classify(rows: DataFrame) -> DataFrame:
    """Severity security > major > minor > patch; rows that are up to date and safe are dropped."""
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_OF_JUMP.items() for x in kv])
    return rows.withColumn("security", F.col("advisories") > 0).withColumn(
        "severity", F.when(F.col("security"), "security").otherwise(table[F.col("jump")])).where(
        F.col("severity").isNotNull() & ~((F.col("advisories") == 0) & F.col("latest").isNull()))


def new_since(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows absent before, with a moved latest version, or newly a security matter."""
    keys = ["project", "type", "package"]
    prev = previous.groupBy(*keys).agg(F.max("latest").alias("_latest"), F.bool_or("security").alias("_security"))
    joined = current.join(prev.withColumn("_seen", F.lit(True)), keys, "left")
    fresh = F.col("_seen").isNull() | ~F.col("_latest").eqNullSafe(F.col("latest")) | (~F.col("_security") & F.col("security"))
    return joined.where(fresh).drop("_seen", "_latest", "_security")


def per_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Counts per severity for every project, those without rows included."""
    counts = rows.groupBy("project").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("security", "major", "minor", "patch")])
    names = ["total", "security", "major", "minor", "patch"]
    return projects.select("project").distinct().join(counts, "project", "left").select(
        "project", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
