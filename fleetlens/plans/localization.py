"""Localization pack: a locale catalog judged against the canonical one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import text as X
from fleetlens.operators.findings import Rule, evaluate


@dataclass(frozen=True)
class Ignore:
    """Ids and checks left out, for all locales or (locale given) for one."""

    ids: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    locale: str | None = None


@dataclass(frozen=True)
class Config:
    ignores: tuple[Ignore, ...] = ()
    placeholders: tuple[str, ...] = X.PLACEHOLDERS
    # (longest canonical length, allowed growth); the last one has no length limit.
    growth: tuple[tuple[int | None, float], ...] = field(default=((15, 2.5), (50, 1.8), (None, 1.4)))
    min_untranslated: int = 5


def _ignored(config: Config, check: str) -> Column:
    out = F.lit(False)
    for rule in config.ignores:
        hit = F.lit(check in rule.checks)
        if rule.ids:
            hit = hit | F.col("id").isin(*rule.ids)
        if rule.locale is not None:
            hit = hit & (F.col("locale") == rule.locale)
        out = out | hit
    return out


def findings(canonical: DataFrame, locales: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of (locale, id, text) catalogs against canonical (id, text).

    Missing ids need every locale beside every canonical id; the locale names
    ride along as one small array per id, so this stays an equi-join.
    """
    names = locales.select("locale").distinct().agg(F.array_sort(F.collect_list("locale")).alias("v")).scalar()
    wanted = canonical.select("id", F.col("text").alias("canon"), F.explode(names).alias("locale"))
    rows = wanted.join(locales.select("locale", "id", F.col("text").alias("local")), ["locale", "id"], "full_outer")
    c, l = F.col("canon"), F.col("local")
    both = c.isNotNull() & l.isNotNull()
    allowed = F.lit(None)
    for limit, factor in reversed(config.growth):
        most = F.floor(F.length(c) * F.lit(factor)).cast("int")
        allowed = most if limit is None else F.when(F.length(c) <= limit, most).otherwise(allowed)
    facts = rows.select(
        "locale", "id", "canon", "local", both.alias("both"), allowed.alias("allowed"),
        X.placeholders(c, config.placeholders).alias("ph_c"), X.placeholders(l, config.placeholders).alias("ph_l"),
        X.tag_names(c).alias("tag_c"), X.tag_names(l).alias("tag_l"), X.tags_imbalanced(l).alias("unbalanced"),
        *[X.count_of(t, s).alias(n) for n, t, s in (
            ("lit_c", c, "\\n"), ("lit_l", l, "\\n"), ("raw_c", c, "\n"), ("raw_l", l, "\n"))],
    )
    f = F.col
    trimmed = F.trim(l)

    def rule(name: str, when: Column, message: Column) -> Rule:
        return Rule(name, F.lit(None).cast("string"), F.coalesce(when, F.lit(False)) & ~_ignored(config, name), message,
                    before=f("canon"), after=f("local"), location=f("locale"))

    return evaluate(facts, "localization", "string", f("id"), [
        rule("missing_key", l.isNull(), F.lit("missing in the locale")),
        rule("extra_key", c.isNull(), F.lit("not in the canonical catalog")),
        rule("placeholder_drift", f("both") & (f("ph_c") != f("ph_l")),
             F.concat(F.array_join("ph_c", ","), F.lit(" vs "), F.array_join("ph_l", ","))),
        rule("tag_imbalance", f("both") & (f("unbalanced") | (f("tag_c") != f("tag_l"))),
             F.when(f("unbalanced"), "tags do not balance").otherwise("tags differ")),
        rule("line_break_drift", f("both") & ((f("lit_c") != f("lit_l")) | (f("raw_c") != f("raw_l"))), F.lit("line breaks differ")),
        rule("untranslated", f("both") & (c == l) & (F.length(trimmed) >= config.min_untranslated) & ~trimmed.rlike(r"^\d+$"),
             F.lit("same as canonical")),
        rule("text_expansion", f("both") & (F.length(c) > 0) & (F.length(l) > f("allowed")),
             F.format_string("%d characters, %d allowed", F.length(l), f("allowed"))),
    ])


def duplicate_ids(catalog: DataFrame) -> DataFrame:
    """Ids that a locale file defines more than once."""
    return catalog.groupBy("locale", "id").agg(F.count("*").alias("n")).where("n > 1")
