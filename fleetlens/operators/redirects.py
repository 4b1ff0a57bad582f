"""Matching old URLs to new ones, and judging the redirect map that comes out."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import text as X, url as U
from fleetlens.operators import graph
from fleetlens.operators.duplicates import collisions
from fleetlens.operators.skew import lookup
from fleetlens.session import staged

# Strategy and score, best first. Fixed values.
STRATEGIES = (("exact_path", 100), ("canonical", 90), ("slug", 80), ("title", 70))


def composed(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with these text columns in Unicode NFC.

    The distinct texts outside ASCII are a dictionary of their own; Python composes
    these only, and just the rows that hold such a text are joined with those that
    change. Null stays null.
    """
    df = staged(df, "texts")
    odd = lambda c: F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    words = reduce(DataFrame.unionByName, [df.where(odd(c)).select(F.col(c).alias("text")) for c in columns]).distinct()
    changed = staged(words.select("text", U.nfc(F.col("text")).alias("_nfc")).where("text <> _nfc"), "dictionary")
    for c in columns:
        some = df.where(odd(c))
        found = lookup(some, changed.withColumnRenamed("text", c), c, [x for x in df.columns if x != c] or [c])
        df = df.where(~odd(c)).unionByName(found.withColumn(c, F.coalesce("_nfc", c)).drop("_nfc"))
    return df


def _keys(df: DataFrame) -> DataFrame:
    """Add one key column per strategy; blank keys are null."""
    null = U.blank_to_null
    if "canonical" not in df.columns:
        df = df.withColumn("canonical", F.lit(None).cast("string"))
    df = composed(df.select(*[c for c in ("url", "canonical", "slug", "title") if c in df.columns], U.decoded_path(F.col("url")).alias("_path"),
                            U.decoded_path(F.col("canonical")).alias("_canonical")), ["_path", "_canonical"])
    has = set(df.columns)
    slug = U.first_filled(F.col("slug"), U.slug(F.col("url"))) if "slug" in has else U.slug(F.col("url"))
    title = U.first_filled(F.col("title"), U.title_from_url(F.col("url"))) if "title" in has else U.title_from_url(F.col("url"))
    return df.select(
        "url", null(U.match_path(F.col("url"), path=F.col("_path"))).alias("exact_path"),
        null(U.match_path(F.col("canonical"), path=F.col("_canonical"))).alias("canonical"), null(slug).alias("slug"),
        null(X.clean_title(title)).alias("title"),
    )


def candidate_keys(destinations: DataFrame) -> DataFrame:
    """Distinct (strategy, key, url): which destinations a key stands for.

    This table lists the candidates of ambiguous matches, one row per candidate
    of a key rather than one per pair of source and candidate.
    """
    keyed = _keys(destinations)
    pairs = F.array(
        F.struct(F.lit("exact_path").alias("strategy"), F.col("exact_path").alias("key")),
        F.struct(F.lit("slug").alias("strategy"), F.col("slug").alias("key")),
        F.struct(F.lit("title").alias("strategy"), F.col("title").alias("key")),
    )
    return keyed.select(F.col("url"), F.explode(pairs).alias("p")).where("p.key is not null").select(
        "p.strategy", "p.key", "url").distinct()


def match(sources: DataFrame, destinations: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per source: target, status, classification, strategy, candidates, match_key.

    The best strategy that knows the source's key decides; one destination url
    is a match, several are ambiguous. Only the number of urls and the smallest
    one are needed per key, so no source-candidate pairs are built. Paths and the
    keys of overrides match in Unicode NFC, however they are written.
    """
    cands = candidate_keys(destinations).groupBy("strategy", "key").agg(
        F.count("*").alias("n"), F.min("url").alias("target"))
    keyed = staged(_keys(sources), "sources")
    cands = staged(cands, "candidates")
    out = keyed
    for strategy, _ in STRATEGIES:
        kind = "exact_path" if strategy == "canonical" else strategy
        dim = cands.where(F.col("strategy") == kind).select(
            F.col("key").alias(strategy), F.struct("n", "target").alias(f"_{strategy}"))
        out = lookup(out, dim, strategy, ["url"], base=keyed)
    best = F.coalesce(*[
        F.when(F.col(f"_{s}").isNotNull(), F.struct(
            F.lit(s).alias("strategy"), F.lit(score).alias("score"), F.col(s).alias("key"),
            F.col(f"_{s}.n").alias("n"), F.col(f"_{s}.target").alias("target"))) for s, score in STRATEGIES
    ])
    matched = out.select("url", "exact_path", best.alias("b"))
    if overrides is None:
        chosen = matched.withColumn("o", F.lit(None).cast("struct<target:string,status:int>"))
    else:
        manual = composed(overrides.select("key", "target", "status"), ["key"]).groupBy(F.col("key").alias("exact_path")).agg(
            F.max(F.struct("target", "status")).alias("o"))
        chosen = lookup(matched, manual, "exact_path", ["url"], base=keyed)
    gone = F.col("o.target").isin("gone", "410")
    manual, none, tie = F.col("o").isNotNull(), F.col("b").isNull(), F.col("b.n") > 1
    return chosen.select(
        F.col("url").alias("source"),
        F.when(manual, F.when(gone, "").otherwise(F.coalesce("o.target", F.lit("")))).when(none | tie, "").otherwise(F.col("b.target")).alias("target"),
        F.when(manual, F.when(gone, 410).otherwise(F.coalesce("o.status", F.lit(301)))).when(none, 404).otherwise(301).alias("status"),
        F.when(manual, "exact").when(none, "missing").when(tie, "ambiguous").when(F.col("b.score") == 100, "exact").otherwise("confident").alias("classification"),
        F.when(manual, "override").when(none, "none").otherwise(F.col("b.strategy")).alias("strategy"),
        F.when(manual, F.lit(0)).otherwise(F.coalesce("b.n", F.lit(0))).cast("bigint").alias("candidates"),
        F.when(~manual, F.col("b.key")).alias("match_key"),
    )


def match_stats(redirects: DataFrame) -> DataFrame:
    """Counts per classification; overrides also count as exact."""
    return redirects.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in ("exact", "confident", "ambiguous", "missing")],
        F.count_if(F.col("strategy") == "override").alias("overrides"),
    )


def is_external(target: Column) -> Column:
    return target.startswith("http://") | target.startswith("https://")


def redirect_edges(entries: DataFrame) -> DataFrame:
    """(src, dst) of the internal redirects with a target; the last entry by seq wins per source."""
    usable = entries.where(
        (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
        & (F.coalesce("status", F.lit(0)) != 410) & (F.coalesce("classification", F.lit("")) != "missing")
        & ~is_external(F.col("target"))
    ).select(U.match_path(F.col("source")).alias("s"), U.match_path(F.col("target")).alias("t"), "seq")
    return graph.last_edge(usable, "s", "t", "seq")


def regex_invalid(pattern: Column) -> Column:
    """Patterns that do not compile; checked in Python, in Arrow batches."""

    def broken(values: pd.Series) -> pd.Series:
        def fails(p: str) -> bool:
            try:
                re.compile(p)
            except re.error:
                return True
            return False
        return values.map(fails)

    return F.pandas_udf(broken, "boolean")(pattern)


def validation_findings(entries: DataFrame) -> DataFrame:
    """(rule, subject, detail, critical) of a redirect map (seq, source, target, status, classification, required)."""
    edges = staged(redirect_edges(entries), "edges")
    walk = graph.walk_ends(edges)
    key = U.match_path(F.col("source"))
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")

    def rows(df: DataFrame, rule: str, subject: Column, detail: Column, critical: bool) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), subject.alias("subject"), text(detail).alias("detail"),
                         F.lit(critical).alias("critical"))

    loops = graph.cycles(edges, walk).groupBy("loop_id").agg(F.count("*").alias("n"))
    chains = graph.maximal_chains(edges, walk)
    collided = collisions(entries.where(F.coalesce("source", F.lit("")) != ""), key, F.col("target"), F.col("status"))
    required = (key == "/") | F.coalesce("required", F.lit(False))
    open_target = (F.coalesce("classification", F.lit("")) == "missing") | (F.coalesce("target", F.lit("")) == "")
    unresolved = entries.where(required & open_target & (F.coalesce("status", F.lit(0)) != 410))
    regex_like = F.col("source").startswith("^") | F.col("source").contains("(") | F.col("source").contains("*")
    patterns = entries.where(regex_like)
    unsafe = patterns.where(X.regex_unsafe_shape(F.col("source")) | regex_invalid(F.col("source")))
    external = entries.where((F.coalesce("status", F.lit(0)) != 410) & (F.coalesce("classification", F.lit("")) != "missing")
                             & is_external(F.col("target")))
    parts = [
        rows(loops, "loop", F.col("loop_id"), F.col("n"), True),
        rows(chains, "chain", F.col("start"), F.concat_ws(" -> ", "start", "end"), False),
        rows(collided, "collision", F.col("source"), F.col("n_targets"), True),
        rows(unresolved, "unresolved_required", F.col("source"), F.lit(""), True),
        rows(unsafe, "unsafe_regex", F.col("source"), F.col("target"), False),
        rows(external, "external_target", F.col("source"), F.col("target"), False),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def is_valid(findings: DataFrame) -> DataFrame:
    return findings.agg((~F.coalesce(F.bool_or("critical"), F.lit(False))).alias("valid"))
