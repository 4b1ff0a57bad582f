"""Comparing two crawls of a site through a URL mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import text as X, url as U
from fleetlens.functions.url import let
from fleetlens.operators.findings import apply_policy
from fleetlens.operators.skew import lookup
from fleetlens.schemas import CRAWL_FIELDS
from fleetlens.session import staged

# Severity per compared field. Fixed values.
DEFAULT_POLICY = {
    "status": "error", "title": "error", "canonical": "error", "robots": "error",
    "description": "warning", "H1": "warning", "content_fingerprint": "warning",
    "language": "warning", "schema_types": "info", "mapping": "warning", "duplicate": "warning",
}


def _sorted_list(col: Column, sep: str, joiner: str, lower: bool = False, unique: bool = False) -> Column:
    parts = F.transform(F.split(col, sep), lambda p: F.trim(F.lower(p) if lower else p))
    parts = F.filter(parts, lambda p: p != "")
    return F.array_join(F.array_sort(F.array_distinct(parts) if unique else parts), joiner)


def json_types(text: Column) -> Column:
    """Values of every "@type" in a JSON text, single or listed."""
    single = F.regexp_extract_all(text, F.lit(r'"@type"\s*:\s*"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(r'"@type"\s*:\s*\[([^\]]*)\]'), F.lit(1))
    inner = F.flatten(F.transform(lists, lambda t: F.regexp_extract_all(t, F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1))))
    return F.concat(single, inner)


def _schema_types(col: Column) -> Column:
    names = F.from_json(col, "array<string>")
    # A plain array of names, an object (or array of objects) with @type, or a comma list.
    of_json = F.when(F.size(json_types(col)) > 0, json_types(col)).otherwise(F.coalesce(names, F.array().cast("array<string>")))
    clean = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(of_json, F.trim), lambda t: t != ""))), ", ")
    is_json = col.rlike(r"(?s)^(\[.*\]|\{.*\})$") & F.try_parse_json(col).isNotNull()
    return F.when(is_json, clean).otherwise(_sorted_list(col, ",", ", ", unique=True))


def _h1(col: Column) -> Column:
    listed = F.from_json(F.when(col.rlike(r"(?s)^\[.*\]$"), col), "array<string>")
    items = F.coalesce(listed, F.split(col, "\n"))
    return F.array_join(F.array_sort(F.filter(F.transform(items, X.collapse_space), lambda t: t != "")), " | ")


def normalized_field(name: str, value: Column) -> Column:
    """Comparable form of one crawl field."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    forms = {
        "title": X.collapse_space, "description": X.collapse_space, "canonical": U.compare_path,
        "robots": lambda c: _sorted_list(c, ",", ", ", lower=True),
        "language": lambda c: F.regexp_replace(F.replace(F.lower(c), F.lit("_"), F.lit("-")), "[\"']", ""),
        "H1": lambda c: let(c, _h1), "schema_types": lambda c: let(c, _schema_types),
    }
    return forms.get(name, lambda c: c)(raw)


def first_rows(crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row per url by seq, urls that occur several times with their count)."""
    grouped = staged(crawl.where(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(
        F.min_by(F.struct(*CRAWL_FIELDS), "seq").alias("r"), F.min("seq").alias("seq"), F.count("*").alias("n")), "crawl")
    return grouped, grouped.where("n > 1").select("url", "n")


def _finding(df: DataFrame, before: Column, after: Column, field: Column, old: Column, new: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    keep = lambda c: null if c is None else c.cast("string")
    return df.select(keep(before).alias("url_before"), keep(after).alias("url_after"), field.alias("field"),
                     old.cast("string").alias("before"), new.cast("string").alias("after"))


def compare_crawls(
    before: DataFrame, after: DataFrame, mapping: DataFrame | None = None, policy: dict[str, str] | None = None,
    fallback: bool = True,
) -> DataFrame:
    """Findings (url_before, url_after, field, before, after, severity) between two crawls.

    `mapping` holds (seq, src, dest). URLs it leaves out pair up by path; only the
    first new url of a path and the first old one can pair.
    """
    old, old_dups = first_rows(before)
    new, new_dups = first_rows(after)
    col, lit = F.col, F.lit
    parts = [
        _finding(old_dups, col("url"), None, lit("duplicate"), F.format_string("%d duplicate rows", "n"), lit("")),
        _finding(new_dups, None, col("url"), lit("duplicate"), lit(""), F.format_string("%d duplicate rows", "n")),
    ]
    pairs = None
    used_old = used_new = None
    if mapping is not None:
        m = staged(mapping.select("seq", "src", "dest"), "mapping")
        first_src = m.groupBy("src").agg(F.min("seq").alias("_fs"))
        first_dest = m.groupBy("dest").agg(F.min("seq").alias("_fd"))
        m = lookup(lookup(m, first_src, "src", ["seq"], base=m), first_dest, "dest", ["seq"], base=m)
        m = lookup(m, old.select(col("url").alias("src"), lit(True).alias("_o")), "src", ["seq"], base=m)
        m = staged(lookup(m, new.select(col("url").alias("dest"), lit(True).alias("_n")), "dest", ["seq"], base=m), "mapped")
        again_src, again_dest = col("seq") > col("_fs"), col("seq") > col("_fd")
        parts.append(_finding(
            m.where(again_src | again_dest), col("src"), col("dest"), lit("duplicate"),
            F.when(again_src, "source mapped before").otherwise(""), F.when(again_dest, "destination mapped before").otherwise("")))
        there = lambda c: F.when(col(c).isNotNull(), "present").otherwise("absent")
        parts.append(_finding(m.where("_o is null or _n is null"), col("src"), col("dest"), lit("mapping"), there("_o"), there("_n")))
        pairs = m.where("_o and _n").select("src", "dest")
        used_old = m.where("_o").select(col("src").alias("url")).distinct()
        used_new = m.where("_n").select(col("dest").alias("url")).distinct()
    rest_old = old if used_old is None else old.join(used_old, "url", "left_anti")
    rest_new = new if used_new is None else new.join(used_new, "url", "left_anti")
    if fallback:
        by_path = lambda df, name: df.groupBy(U.compare_path(col("url")).alias("path")).agg(
            F.min_by("url", "seq").alias(name))
        matched = staged(by_path(rest_old, "src").join(by_path(rest_new, "dest"), "path").select("src", "dest"), "by_path")
        pairs = matched if pairs is None else pairs.unionByName(matched)
        rest_old = rest_old.join(matched.select(col("src").alias("url")), "url", "left_anti")
        rest_new = rest_new.join(matched.select(col("dest").alias("url")), "url", "left_anti")
    parts.append(_finding(rest_old, col("url"), None, lit("mapping"), lit("no counterpart"), lit("")))
    parts.append(_finding(rest_new, None, col("url"), lit("mapping"), lit(""), lit("no counterpart")))
    if pairs is not None:
        parts.append(_field_changes(staged(pairs, "pairs"), old, new))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return apply_policy(out, "field", {**DEFAULT_POLICY, **(policy or {})}, "warning")


def _field_changes(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    both = lookup(pairs, old.select(F.col("url").alias("src"), F.col("r").alias("a")), "src", ["dest"], "inner", base=pairs)
    both = lookup(both, new.select(F.col("url").alias("dest"), F.col("r").alias("b")), "dest", ["src"], "inner", base=pairs)
    changes = F.array_compact(F.array(*[
        F.when(normalized_field(f, F.col(f"a.{f}")) != normalized_field(f, F.col(f"b.{f}")),
               F.struct(F.lit(f).alias("field"), F.coalesce(f"a.{f}", F.lit("")).alias("before"),
                        F.coalesce(f"b.{f}", F.lit("")).alias("after"))) for f in CRAWL_FIELDS
    ]))
    rows = both.select("src", "dest", F.explode(changes).alias("c"))
    return _finding(rows, F.col("src"), F.col("dest"), F.col("c.field"), F.col("c.before"), F.col("c.after"))
