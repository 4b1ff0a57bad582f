"""Content freshness pack: stale, thin, duplicated, badly outlined and orphaned pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import text as X, url as U
from fleetlens.operators.duplicates import duplicate_members
from fleetlens.operators.findings import Rule, evaluate, union_all
from fleetlens.operators.links import orphans
from fleetlens.session import staged

# rule -> (severity, score). Fixed values.
SCORES = {
    "orphan_page": ("Critical", 100),
    "duplicate_title": ("High", 80),
    "duplicate_description": ("Medium-High", 60),
    "stale_content": ("Medium", 50),
    "multiple_h1s": ("Medium", 40),
    "missing_h1": ("Medium", 40),
    "thin_content": ("Medium-Low", 30),
    "non_sequential_headings": ("Low", 20),
    "no_headings": ("Low", 20),
    "unknown_date": ("Low", 10),
}


@dataclass(frozen=True)
class PathRule:
    """Settings for the paths that match a pattern; None leaves a setting alone."""

    path: str
    exclude: bool | None = None
    freshness_days: float | None = None
    thin_words: int | None = None
    entry_pages: list[str] | None = None


@dataclass(frozen=True)
class Config:
    freshness_days: float = 365
    thin_words: int = 300
    entry_pages: list[str] = field(default_factory=lambda: ["/", "/index.html", "/home"])
    rules: list[PathRule] = field(default_factory=list)


def resolve_rules(pages: DataFrame, config: Config, path: str = "path") -> DataFrame:
    """Add exclude, freshness_days, thin_words, is_entry; each from the last matching rule that sets it.

    The rules come from a config file, so they compile to one conditional per
    setting: no join and no shuffle.
    """
    def last_set(name: str, default: object, kind: str) -> Column:
        out = F.lit(default).cast(kind)
        for rule in config.rules:
            value = getattr(rule, name)
            if value is not None:
                out = F.when(F.col(path).rlike(rule.path), F.lit(value).cast(kind)).otherwise(out)
        return out

    entry = F.col(path).isin(config.entry_pages)
    for rule in config.rules:
        if rule.entry_pages is not None:
            entry = F.when(F.col(path).rlike(rule.path), F.col(path).isin(rule.entry_pages)).otherwise(entry)
    return pages.select(
        "*", last_set("exclude", False, "boolean").alias("exclude"),
        last_set("freshness_days", config.freshness_days, "double").alias("freshness_days"),
        last_set("thin_words", config.thin_words, "int").alias("thin_words"), entry.alias("is_entry"),
    )


def heading_levels(headings: Column) -> Column:
    """Levels of the 'Hn: text' entries in order; other entries are skipped."""
    marks = F.transform(headings, lambda h: F.regexp_extract(F.trim(h), r"(?i)^h([1-6])\b", 1))
    return F.transform(F.filter(marks, lambda m: m != ""), lambda m: m.cast("int"))


def heading_skips(headings: Column) -> Column:
    """array<struct<from, to>> of the levels that go down by more than one step."""
    levels = heading_levels(headings)
    n = F.size(levels)
    pairs = F.zip_with(
        F.slice(levels, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("from"), b.alias("to")),
    )
    return F.filter(pairs, lambda p: p["to"] > p["from"] + 1)


def active_pages(pages: DataFrame, config: Config) -> DataFrame:
    located = pages.withColumn("path", U.relative_path(F.col("url")))
    return resolve_rules(located, config).where(~F.col("exclude"))


def findings(pages: DataFrame, config: Config, now: str) -> DataFrame:
    """All findings of the pack; `now` is the reference time as an ISO string."""
    date = F.col("date").try_cast("timestamp")
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(date)) / F.lit(86_400_000.0)
    headings = F.coalesce("headings", F.array().cast("array<string>"))
    # The page bodies are read here, once; every rule works on the staged facts.
    facts = staged(active_pages(pages, config).select(
        "url", "path", "links", "is_entry", "freshness_days", "thin_words", age.alias("age"),
        X.text_key(F.col("title")).alias("title"), X.text_key(F.col("meta_desc")).alias("meta_desc"),
        X.word_count(F.col("content")).alias("words"), F.size(headings).alias("n_headings"),
        F.size(F.filter(headings, lambda h: F.trim(h).rlike(r"(?i)^h1\b"))).alias("n_h1"),
        heading_skips(headings).alias("skips"),
    ), "facts")
    return union_all([_page_rules(facts), _skips(facts), *_duplicates(facts), _orphans(facts)])


def _rule(name: str, when: Column, message: Column) -> Rule:
    severity, score = SCORES[name]
    return Rule(name, severity, when, message, score=score)


def _page_rules(facts: DataFrame) -> DataFrame:
    c = F.col
    return evaluate(facts, "freshness", "page", c("path"), [
        _rule("unknown_date", c("age").isNull(), F.lit("date missing or not readable")),
        _rule("stale_content", c("age") > c("freshness_days"),
              F.format_string("%d days old, limit %s", F.floor("age"), c("freshness_days").cast("int").cast("string"))),
        _rule("thin_content", c("words") < c("thin_words"), F.format_string("%d words, limit %d", c("words"), c("thin_words"))),
        _rule("no_headings", c("n_headings") == 0, F.lit("no headings")),
        _rule("missing_h1", (c("n_headings") > 0) & (c("n_h1") == 0), F.lit("no H1")),
        _rule("multiple_h1s", c("n_h1") > 1, F.format_string("%d H1 headings", c("n_h1"))),
    ])


def _skips(facts: DataFrame) -> DataFrame:
    rows = facts.select("path", F.explode("skips").alias("s"))
    return evaluate(rows, "freshness", "page", F.col("path"), [
        _rule("non_sequential_headings", F.lit(True), F.format_string("H%d to H%d", F.col("s.from"), F.col("s.to"))),
    ])


def _duplicates(facts: DataFrame) -> list[DataFrame]:
    out = []
    for rule, column in (("duplicate_title", "title"), ("duplicate_description", "meta_desc")):
        members = duplicate_members(facts, F.col(column), "path")
        out.append(evaluate(members, "freshness", "page", F.col("path"), [
            _rule(rule, F.lit(True), F.format_string("shared with %d other page(s)", F.col("n") - 1)),
        ]))
    return out


def _orphans(facts: DataFrame) -> DataFrame:
    entries = facts.where("is_entry").select("path").distinct()
    lonely = orphans(facts, []).join(entries, "path", "left_anti")
    return evaluate(lonely, "freshness", "page", F.col("path"), [
        _rule("orphan_page", F.lit(True), F.lit("no inbound links")),
    ])


def priorities(found: DataFrame) -> DataFrame:
    """Per page: sum of its finding scores and number of findings."""
    return found.groupBy("entity_id").agg(F.sum("score").alias("priority"), F.count("*").alias("findings"))
