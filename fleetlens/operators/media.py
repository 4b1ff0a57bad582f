"""Reconciling media references with the files on disk."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import url as U
from fleetlens.operators.nested import json_values
from fleetlens.operators.parts import tasks
from fleetlens.operators.skew import lookup
from fleetlens.session import staged

#: Paths that a task gets: it sorts them and the files, with all their keys, for each step of the cascade.
PATHS = 50_000


def visible_files(files: DataFrame) -> DataFrame:
    """(path, size) without hidden and server files, plus the keys the cascade uses."""
    name = F.lower(U.basename(F.col("path")))
    return files.where(~name.startswith(".") & ~name.isin("web.config", "index.php")).select(
        "path", "size", F.lower("path").alias("low"), name.alias("name"),
        U.image_parent(F.col("path")).alias("parent"), U.image_size(F.col("path")).alias("suffix"))


def resolve_ids(refs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Fill the path of references (ref_id, path, attachment_id) that name an attachment id; unknown ids stay null."""
    paths = attachments.select("attachment_id", F.col("path").alias("_p"))
    return lookup(refs, paths, "attachment_id", ["ref_id"]).withColumn("path", F.coalesce("path", "_p")).drop("_p")


def cascade(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Per distinct referenced path: how it was found and how many files stand for it.

    exact path, then same path in other case (the largest such path), then same
    file name anywhere (all copies), else missing.
    """
    paths = staged(refs.where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.count("*").alias("n_refs")).select(
        "path", "n_refs", F.lower("path").alias("low"), F.lower(U.basename(F.col("path"))).alias("name")), "refs")
    n = tasks(paths, max(paths.count(), files.count()), PATHS)
    out = lookup(paths, files.select("path", F.col("path").alias("exact")), "path", ["n_refs"], base=paths, tasks=n)
    out = lookup(out, files.groupBy("low").agg(F.max("path").alias("other_case")), "low", ["path"], base=paths, tasks=n)
    out = lookup(out, files.groupBy("name").agg(F.count("*").alias("copies")), "name", ["path"], base=paths, tasks=n)
    step = (F.when(F.col("exact").isNotNull(), "exact").when(F.col("other_case").isNotNull(), "case")
            .when(F.col("copies").isNotNull(), "name").otherwise("missing"))
    return out.select(
        "path", "n_refs", step.alias("step"), "name",
        F.when(step == "exact", F.col("exact")).when(step == "case", F.col("other_case")).alias("file"),
        F.when(step == "name", F.col("copies")).otherwise(F.when(step == "missing", 0).otherwise(1)).cast("bigint").alias("n_files"))


def used_families(cascaded: DataFrame, files: DataFrame) -> DataFrame:
    """Parents of the files that references reach; a family is used as a whole."""
    direct = cascaded.where("file is not null").select(U.image_parent(F.col("file")).alias("parent"))
    names = cascaded.where("step = 'name'").select("name").distinct()
    by_name = files.join(names, "name", "left_semi").select("parent")
    return direct.unionByName(by_name).distinct()


def reconcile(refs: DataFrame, raw_files: DataFrame) -> DataFrame:
    """(class, path, detail): present, missing, unused, broken_derivative and collision rows."""
    files = staged(visible_files(raw_files), "files")
    found = staged(cascade(refs, files), "cascade")
    used = staged(used_families(found, files), "families")
    col, lit = F.col, F.lit
    derivative = F.when(col("suffix").isNotNull(), "derivative").otherwise("original")
    present = files.join(used, "parent", "left_semi").select(lit("present").alias("class"), "path", derivative.alias("detail"))
    unused = files.join(used, "parent", "left_anti").select(lit("unused").alias("class"), "path", derivative.alias("detail"))
    missing = found.where("step = 'missing'").select(
        lit("missing").alias("class"), "path", F.when(U.image_size(col("path")).isNotNull(), "derivative").otherwise("original").alias("detail"))
    parents = files.select(col("path").alias("parent"))
    orphaned = files.where("suffix is not null").join(parents, "parent", "left_anti")
    broken = orphaned.join(used.withColumn("_u", lit(True)), "parent", "left").select(
        lit("broken_derivative").alias("class"), "path", F.when(col("_u"), "used").otherwise("unused").alias("detail"))
    clash = files.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("low").alias("n_low")).where("n > 1").select(
        lit("collision").alias("class"), col("name").alias("path"), F.when(col("n_low") == 1, "Case Conflict").otherwise("Path Divergence").alias("detail"))
    out = present
    for part in (unused, missing, broken, clash):
        out = out.unionByName(part)
    return out


# File extensions of media. Fixed values.
MEDIA = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".pdf", ".mp3", ".mp4", ".mov", ".wav", ".ogg", ".zip", ".svg", ".avif")


def is_media(url: Column) -> Column:
    bare = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    return bare.rlike(r"\.(" + "|".join(e[1:] for e in MEDIA) + r")$")


def html_references(pages: DataFrame, bases: tuple[str, ...] = ()) -> DataFrame:
    """(source, raw, context, path) of the media named in src/href, srcset and url() of (source, html)."""
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    srcset = F.flatten(F.transform(every(r"(?i)srcset=['\"]([^'\"]+)['\"]"), lambda v: F.filter(
        F.transform(F.split(v, ","), lambda e: F.regexp_extract(e, r"^\s*(\S+)", 1)), lambda u: u != "")))
    tagged = lambda urls, context: F.transform(urls, lambda u: F.struct(u.alias("raw"), F.lit(context).alias("context")))
    refs = F.concat(
        tagged(every(r"(?i)(?:src|href)=['\"]([^'\"]+)['\"]"), "attribute"), tagged(srcset, "srcset"),
        tagged(every(r"(?i)url\(['\"]?([^'\")]+)['\"]?\)"), "style"))
    return pages.select("source", F.inline(refs)).where(is_media(F.col("raw"))).withColumn(
        "path", U.upload_path(F.col("raw"), bases))


def serialized_strings(text: Column) -> Column:
    """array<struct<start, stop, value>> of the strings in length-prefixed data (s:5:"hello"), in order; places count bytes.

    A string is as long in bytes as its prefix says, so what looks like a string
    inside one is its text. Where no quote closes it there, it ends at the next
    quote with a semicolon; without one the prefix is passed over. Null gives null.
    """
    prefix = re.compile(rb's:(\d{1,10}):"')

    def strings(texts: pd.Series) -> pd.Series:
        def read(t: str) -> list[dict]:
            raw, at, out = t.encode(), 0, []
            while m := prefix.search(raw, at):
                stop = m.end() + int(m[1])
                if raw[stop:stop + 1] != b'"':
                    stop = raw.find(b'";', m.end())
                at = m.end() if stop < 0 else stop + 1
                if stop >= 0:
                    out.append({"start": m.start(), "stop": at, "value": raw[m.end():stop].decode(errors="replace")})
            return out
        return texts.map(read, na_action="ignore")

    return F.pandas_udf(strings, "array<struct<start:bigint,stop:bigint,value:string>>")(text)


def _file_names(strings: Column) -> Column:
    """The strings that stand right behind the key "file"."""
    def named(s: Column, i: Column) -> Column:
        before = F.get(strings, i - 1)
        return F.coalesce((F.lower(before["value"]) == "file") & (before["stop"] + 1 == s["start"]), F.lit(False))
    return F.transform(F.filter(strings, named), lambda s: s["value"])


def thumbnail_references(attachments: DataFrame) -> DataFrame:
    """Sizes named in serialized attachment metadata (source, path, metadata), placed beside their parent."""
    read = attachments.select("source", "path", serialized_strings(F.col("metadata")).alias("strings"))
    folder = F.regexp_extract("path", r"^(.*/)?", 0)
    name = F.replace("raw", F.lit("\\"), F.lit("/"))
    return read.select("source", "path", F.explode(_file_names(F.col("strings"))).alias("raw")).where("raw <> ''").select(
        "source", "raw", F.lit("thumbnail").alias("context"),
        F.when(name.contains("/"), name).otherwise(F.concat(folder, name)).alias("path"))


def _kind(text: Column) -> Column:
    """json, serialized, markup, broken (JSON that can't be read) or text."""
    opened = text.rlike(r"^\s*[{\[]")
    return (F.when(opened & F.try_parse_json(text).isNotNull(), "json").when(text.rlike(r"^\s*[aO]:\d+:"), "serialized")
            .when(text.rlike(r"(?i)<img|(src|href|srcset)=|url\("), "markup").when(opened, "broken").otherwise("text"))


def media_references(payloads: DataFrame, bases: tuple[str, ...] = ()) -> DataFrame:
    """(source, place, context, raw, path) of the media named at any depth in payloads (source, path, text).

    A payload is JSON, serialized metadata, markup (HTML or CSS) or one bare path, and
    can hold others: strings of JSON, JSON in block comments of markup, strings of
    metadata. Each round reads what the last one found inside, so nesting costs rounds;
    what is inside is shorter than what holds it. `place` leads to the payload that
    names the file (a.b[0], block[i], string[i]); `path` of a payload is the attachment
    whose sizes its metadata lists. Null and empty texts name nothing; repeated
    references stay.
    """
    level = payloads.select("source", F.col("path").alias("beside"), F.lit("").alias("place"), "text")
    parts = []
    keys = ["source", "beside", "place"]
    inside = lambda step: F.concat_ws(".", F.nullif("place", F.lit("")), step).alias("place")
    while True:
        level = staged(level.where("text <> ''").withColumn("kind", _kind(F.col("text"))), "payloads")
        kinds = {r.kind for r in level.select("kind").distinct().collect()}
        of = {k: level.where(F.col("kind") == k) for k in kinds}
        inner = []
        bare = lambda df, raw, context: df.select("source", "place", raw.alias("raw"), F.lit(context).alias("context")).where(
            is_media(F.col("raw"))).withColumn("path", U.upload_path(F.col("raw"), bases))
        if "text" in of:
            parts.append(bare(of["text"], F.col("text"), "text"))
        if "broken" in of:
            parts.append(bare(of["broken"], F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(https?://[^\s'\"\\<>]+)"), F.lit(1))), "address"))
        if "json" in of:
            values, _ = json_values(of["json"].select(F.struct(*keys).alias("holder"), "text"), ["holder"])
            strings = values.where("kind = 'string'").select("holder.*", "path", F.variant_get("value", "$", "string").alias("text"))
            inner.append(strings.select("source", "beside", inside(F.col("path")), "text"))
        if "markup" in of:
            packed = of["markup"].select(F.struct("source", "place").alias("source"), F.col("text").alias("html"))
            parts.append(html_references(packed, bases).select("source.source", "source.place", "raw", "context", "path"))
            blocks = F.regexp_extract_all("text", F.lit(r"(?s)<!--\s*wp:[^{>]*(\{.*?\})\s*/?-->"), F.lit(1))
            inner.append(of["markup"].select(*keys, F.posexplode(blocks).alias("pos", "text")).select(
                "source", "beside", inside(F.concat(F.lit("block["), "pos", F.lit("]"))), "text"))
        if "serialized" in of:
            packed = of["serialized"].select(F.struct("source", "place").alias("source"), F.col("beside").alias("path"), F.col("text").alias("metadata"))
            parts.append(thumbnail_references(packed).select("source.source", "source.place", "raw", "context", "path"))
            strings = F.transform(serialized_strings(F.col("text")), lambda s: s["value"])
            inner.append(of["serialized"].select(*keys, F.posexplode(strings).alias("pos", "text")).select(
                "source", "beside", inside(F.concat(F.lit("string["), "pos", F.lit("]"))), "text").where(_kind(F.col("text")) != "text"))
        if not inner:
            out = reduce(DataFrame.unionByName, parts) if parts else html_references(
                level.select("source", F.col("text").alias("html"))).withColumn("place", F.lit(""))
            return out.select("source", "place", "context", "raw", "path")
        level = reduce(DataFrame.unionByName, inner)
