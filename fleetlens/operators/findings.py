"""Building, counting, ordering and gating findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.ordered import ranked
from fleetlens.schemas import FINDING

# Severity order per pack, worst first. Fixed values.
SEVERITY_ORDER = {
    "freshness": ("Critical", "High", "Medium-High", "Medium", "Medium-Low", "Low"),
    "site_audit": ("blocker", "warning", "info"),
    "metadata": ("error", "warning", "info", "ignore"),
    "policy": ("critical", "high", "medium", "low"),
    "secrets": ("high", "medium", "low", "info"),
    "capture": ("error", "warn", "info"),
    "monitor": ("red", "amber", "green"),
    "dependency": ("security", "major", "minor", "patch"),
}


@dataclass(frozen=True)
class Rule:
    """One rule of a pack: when `when` holds, the row yields a finding."""

    rule: str
    severity: str | Column
    when: Column
    message: Column
    score: int | None = None
    confidence: str | Column | None = None
    before: Column | None = None
    after: Column | None = None
    location: Column | None = None
    fix: str | Column | None = None
    attrs: Column | None = None


def _as_col(value: object, kind: str) -> Column:
    col = value if isinstance(value, Column) else F.lit(value)
    return col.cast(kind)


def _struct(pack: str, entity_type: str, entity: Column, r: Rule) -> Column:
    parts = {
        "pack": pack, "rule": r.rule, "entity_type": entity_type, "entity_id": entity,
        "severity": r.severity, "score": r.score, "confidence": r.confidence,
        "message": r.message, "before": r.before, "after": r.after, "location": r.location,
        "fix": r.fix, "attrs": r.attrs,
    }
    return F.struct(*[
        _as_col(parts[f.name], f.dataType.simpleString()).alias(f.name) for f in FINDING.fields
    ])


def evaluate(
    facts: DataFrame, pack: str, entity_type: str, entity: Column, rules: list[Rule]
) -> DataFrame:
    """All rules of a pack in one projection over `facts`: one scan, one explode."""
    hits = F.array_compact(F.array(*[
        F.when(r.when, _struct(pack, entity_type, entity, r)) for r in rules
    ]))
    return facts.select(F.explode(hits).alias("f")).select("f.*")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of rule-pack outputs by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def severity_rank(severity: Column, order: tuple[str, ...]) -> Column:
    """0 for the worst severity of the scale, len(order) for an unknown one."""
    rank = F.lit(len(order))
    for i in reversed(range(len(order))):
        rank = F.when(severity == order[i], F.lit(i)).otherwise(rank)
    return rank


def pack_rank(pack: Column, severity: Column) -> Column:
    out = F.lit(99)
    for name, order in SEVERITY_ORDER.items():
        out = F.when(pack == name, severity_rank(severity, order)).otherwise(out)
    return out


def apply_policy(findings: DataFrame, field: str, policy: dict[str, str], default: str) -> DataFrame:
    """Set each finding's severity from a field -> severity policy; `ignore` drops it."""
    table = F.create_map(*[F.lit(x) for kv in policy.items() for x in kv])
    return findings.withColumn(
        "severity", F.coalesce(table[F.col(field)], F.lit(default))
    ).where(F.col("severity") != "ignore")


def select_packs(findings: DataFrame, only: list[str]) -> DataFrame:
    """Keep the named packs; prunes partitions when findings are stored by pack."""
    return findings.where(F.col("pack").isin(only)) if only else findings


def severity_counts(findings: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """One row per `by` with one count column per severity of the scale."""
    return findings.groupBy(by).agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower().replace("-", "_")) for s in order],
        F.count("*").alias("total"),
    )


def severity_matrix(findings: DataFrame, category: str = "rule") -> DataFrame:
    """Counts by (category, severity) and by severity alone (category = '(all)')."""
    return (
        findings.groupingSets([[category, "severity"], ["severity"]], category, "severity")
        .agg(F.count("*").alias("n"), F.grouping(category).alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("(all)")).otherwise(F.col(category)).alias("category"),
            "severity", "n",
        )
    )


def gate(findings: DataFrame, order: tuple[str, ...], threshold: str) -> DataFrame:
    """One row: does any finding reach the threshold severity?"""
    worst = severity_rank(F.col("severity"), order)
    return findings.agg(
        F.coalesce(F.bool_or(worst <= order.index(threshold)), F.lit(False)).alias("failed"),
        F.count_if(worst <= order.index(threshold)).alias("n_at_or_above"),
    )


def risk_rollup(findings: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Per item: how many findings, its worst severity and its distinct messages, joined."""
    per_message = findings.groupBy(*keys, "message").agg(
        F.min(severity_rank(F.col("severity"), order)).alias("_rank"), F.count("*").alias("_n")
    )
    names = F.array(*[F.lit(s) for s in order])
    return per_message.groupBy(*keys).agg(
        F.sum("_n").alias("n_findings"),
        F.get(names, F.min("_rank")).alias("highest"),
        F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("messages"),
    )


def ordered(findings: DataFrame) -> DataFrame:
    """Deterministic presentation order: pack, severity rank, rule, entity, message."""
    return findings.orderBy(
        "pack", pack_rank(F.col("pack"), F.col("severity")), "rule", "entity_id", "message"
    )


def worst_first(findings: DataFrame) -> DataFrame:
    """Severity, then confidence (high, medium, low), then location."""
    confidence = severity_rank(F.col("confidence"), ("high", "medium", "low"))
    return findings.orderBy(
        pack_rank(F.col("pack"), F.col("severity")), confidence, "location", "entity_id"
    )


def by_priority(pages: DataFrame) -> DataFrame:
    """Pages with their place: highest priority first, then by entity."""
    return ranked(pages, [("priority", True), ("entity_id", False)], "place")


def by_project(rows: DataFrame, order: tuple[str, ...], key: list[str]) -> DataFrame:
    """Dependency rows with their place: worst severity first (as `order` has them), then by `key`, which must be unique."""
    keyed = rows.withColumn("_worst", severity_rank(F.col("severity"), order))
    return ranked(keyed, [("_worst", False), *[(k, False) for k in key]], "place").drop("_worst")


def compare_runs(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """new / unchanged / resolved per finding key between two runs."""
    cur = current.groupBy(*keys).agg(F.lit(True).alias("_cur"))
    prev = previous.groupBy(*keys).agg(F.lit(True).alias("_prev"))
    state = (
        F.when(F.col("_prev").isNull(), "new")
        .when(F.col("_cur").isNull(), "resolved")
        .otherwise("unchanged")
    )
    return cur.join(prev, keys, "full_outer").select(*keys, state.alias("state"))
