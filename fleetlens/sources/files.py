"""Readers for crawls, manifests, mappings, inventories, snapshots and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens import schemas as S
from fleetlens.functions import url as U

# Column names a crawl may use per field, in order of preference. Fixed values.
CRAWL_ALIASES = {
    "url": ("url", "address", "loc", "href", "link", "page url", "page_url", "slug"),
    "status": ("status", "status_code", "statuscode", "code", "http status", "http_status"),
    "title": ("title", "page_title", "page title", "seo title", "seo_title", "meta_title", "meta title"),
    "description": ("description", "meta_description", "meta description", "seo description", "seo_description"),
    "canonical": ("canonical", "canonical_url", "canonical url", "canonical_link", "canonical link"),
    "robots": ("robots", "meta_robots", "meta robots", "robots_meta", "robots meta"),
    "language": ("language", "lang", "locale", "html_lang", "html lang"),
    "H1": ("h1", "h1_content", "h1 content", "heading1", "heading 1", "h1s"),
    "schema_types": ("schema_types", "schema types", "schema", "schema_jsonld", "schemas", "jsonld"),
    "content_fingerprint": ("content_fingerprint", "content fingerprint", "fingerprint", "content_hash", "hash", "fingerprint_hash", "content hash"),
}
OLD_URL = ("old_url", "old", "source", "from", "legacy_url", "legacy", "before", "url_before")
NEW_URL = ("new_url", "new", "destination", "to", "migrated_url", "migrated", "after", "url_after")
SEQ = F.monotonically_increasing_id
MAP = "map<string,string>"


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; torn lines are skipped, or fail the job when `strict`."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def _csv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    return spark.read.csv(path, header=header, multiLine=True, quote='"', escape='"', inferSchema=False)


def _present(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    by_name = {c.lstrip("﻿").strip().lower(): c for c in columns}
    return next((by_name[a] for a in aliases if a in by_name), None)


def _key(m: Column, aliases: tuple[str, ...]) -> Column:
    """Value of the first alias the record has, even when that value is blank."""
    return F.coalesce(*[F.when(F.map_contains_key(m, a), F.struct(F.try_element_at(m, F.lit(a)).alias("v"))) for a in aliases])["v"]


def _lower_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, v: F.lower(F.trim(k)))


def _clean_crawl(df: DataFrame) -> DataFrame:
    rows = df.withColumn("url", F.trim("url")).withColumn("status", F.trim("status"))
    return rows.where(F.coalesce("url", F.lit("")) != "")


def crawl_csv(spark: SparkSession, path: str) -> DataFrame:
    """Crawl table with the canonical columns plus `seq`, from a CSV with any known header names."""
    raw = _csv(spark, path, header=True)
    cols = []
    for name, aliases in CRAWL_ALIASES.items():
        found = _present(raw.columns, aliases)
        cols.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return _clean_crawl(raw.select(SEQ().alias("seq"), *cols))


def crawl_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """As crawl_csv from JSON lines, where each record may use its own names."""
    m = _lower_keys(F.from_json("value", MAP))
    raw = spark.read.text(path).select(SEQ().alias("seq"), m.alias("m")).where("m is not null")
    return _clean_crawl(raw.select("seq", *[_key(F.col("m"), a).alias(n) for n, a in CRAWL_ALIASES.items()]))


def url_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(seq, src, dest) pairs from CSV (headed or not), JSON list, JSON object or JSON lines."""
    if path.lower().endswith((".json", ".jsonl")):
        return _json_mapping(spark, path)
    raw = _csv(spark, path, header=False)
    first = [(v or "").lstrip("﻿").strip().lower() for v in (raw.first() or [])]
    old, new = (next((first.index(a) for a in names if a in first), None) for names in (OLD_URL, NEW_URL))
    headed = any(f in OLD_URL + NEW_URL for f in first)
    if old is None or new is None:
        old, new = 0, 1
    pairs = raw.select(SEQ().alias("seq"), F.trim(raw.columns[old]).alias("src"), F.trim(raw.columns[new]).alias("dest"))
    if headed:
        # The header is the one row whose cells are the header names.
        pairs = pairs.where(~((F.lower(F.regexp_replace("src", "^﻿", "")) == first[old]) & (F.lower("dest") == first[new])))
    return pairs.where("src is not null and dest is not null")


def _sequence(file_seq: Column, pos: Column) -> Column:
    """One number that orders by file, then position, however many entries a file has."""
    return file_seq.cast("decimal(20,0)") * F.lit(10 ** 12).cast("decimal(13,0)") + pos


def _json_mapping(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=not path.lower().endswith(".jsonl")).select(SEQ().alias("file_seq"), F.trim("value").alias("v"))
    rows = F.coalesce(F.from_json("v", f"array<{MAP}>"), F.array(F.from_json("v", MAP)))
    items = text.select("file_seq", F.posexplode(rows).alias("pos", "m"))
    low = items.select(_sequence(F.col("file_seq"), F.col("pos")).alias("seq"), F.col("m"), _lower_keys(F.col("m")).alias("k"))
    pair = low.withColumn("src", _key(F.col("k"), OLD_URL)).withColumn("dest", _key(F.col("k"), NEW_URL))
    named = pair.where("src is not null and dest is not null").select("seq", F.trim("src").alias("src"), F.trim("dest").alias("dest"))
    plain = pair.where("src is null and dest is null").select("seq", F.explode("m").alias("src", "dest")).select(
        "seq", F.trim("src").alias("src"), F.trim("dest").alias("dest"))
    return named.unionByName(plain)


def redirect_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(key, target, status) by normalised source path; the last entry per key wins."""
    sources, targets, codes = ("source", "old_path", "old", "source_path"), ("target", "new_path", "new", "target_path"), ("status", "redirect_status", "code")
    if path.lower().endswith(".csv"):
        raw = _csv(spark, path, header=True)
        s, t, c = (_present(raw.columns, n) for n in (sources, targets, codes))
        if s is None or t is None:
            raw, c = _csv(spark, path, header=False), None
            s, t = raw.columns[:2]
        rows = raw.select(SEQ().alias("seq"), F.col(f"`{s}`").alias("source"), F.coalesce(F.col(f"`{t}`"), F.lit("")).alias("target"),
                          (F.col(f"`{c}`").try_cast("int") if c else F.lit(None).cast("int")).alias("status"))
    else:
        text = spark.read.text(path, wholetext=True).select("value")
        listed = text.select(F.posexplode(F.from_json("value", f"array<{MAP}>")).alias("seq", "m")).select(
            "seq", _key(F.col("m"), sources).alias("source"), _key(F.col("m"), targets).alias("target"), _key(F.col("m"), codes).try_cast("int").alias("status"))
        obj = text.select(F.posexplode(F.from_json("value", MAP)).alias("seq", "source", "v")).withColumn("o", F.from_json("v", MAP))
        keyed = obj.select("seq", "source", F.when(F.col("o").isNull(), F.col("v")).otherwise(U.first_filled(F.try_element_at("o", F.lit("target")), F.lit("gone"))).alias("target"),
                           F.try_element_at("o", F.lit("status")).try_cast("int").alias("status"))
        rows = listed.unionByName(keyed)
    return rows.where(F.coalesce("source", F.lit("")) != "").groupBy(U.match_path(F.col("source")).alias("key")).agg(
        F.max_by(F.struct("target", F.coalesce("status", F.lit(301)).alias("status")), "seq").alias("r")).select("key", "r.target", "r.status")


def destinations(spark: SparkSession, path: str) -> DataFrame:
    """(url, slug, title, canonical) from a sitemap, a JSON manifest or a text list with # comments."""
    null = F.lit(None).cast("string")
    low = path.lower()
    if low.endswith(".xml"):
        rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(
            F.trim("loc").alias("url"), null.alias("slug"), null.alias("title"), null.alias("canonical"))
    elif low.endswith(".json"):
        rows = page_manifest(spark, path).select("url", F.nullif("slug", F.lit("")).alias("slug"), F.nullif("title", F.lit("")).alias("title"), null.alias("canonical"))
    else:
        line = F.trim("value")
        rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("url"), null.alias("slug"), null.alias("title"), null.alias("canonical"))
    u = F.col("url")
    return rows.select("url", U.first_filled(F.col("slug"), U.slug(u)).alias("slug"), U.first_filled(F.col("title"), U.title_from_url(u)).alias("title"), "canonical")


_ITEM = S.struct(
    url=T.StringType(), canonical=T.StringType(), title=T.StringType(), metaDesc=T.StringType(), description=T.StringType(), meta_description=T.StringType(),
    date=T.StringType(), modified=T.StringType(), publishDate=T.StringType(), published=T.StringType(), headings=T.ArrayType(T.StringType()), h1=T.StringType(),
    content=T.StringType(), links=T.ArrayType(T.StringType()), outbound=T.ArrayType(T.StringType()), slug=T.StringType())


def _page(p: str, fallback_url: Column, content: Column, slug: Column) -> list[Column]:
    """Page columns from a manifest item; '' counts as missing, as in the sources."""
    f = lambda *names: U.first_filled(*[F.col(f"{p}.{n}") for n in names])
    none = F.array().cast("array<string>")
    return [
        F.coalesce(f("url", "canonical"), fallback_url).alias("url"), F.coalesce(f("title"), F.lit("")).alias("title"),
        F.coalesce(f("metaDesc", "description", "meta_description"), F.lit("")).alias("meta_desc"), f("date", "modified", "publishDate", "published").alias("date"),
        F.coalesce(f"{p}.headings", F.when(f("h1").isNotNull(), F.array(F.concat(F.lit("H1: "), f("h1")))), none).alias("headings"),
        content.alias("content"), F.coalesce(f"{p}.links", f"{p}.outbound", none).alias("links"), F.coalesce(f("slug"), slug).alias("slug")]


def page_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a manifest: an array, {"pages": []} or {"urls": []}; a plain string is a url."""
    text = spark.read.text(path, wholetext=True)
    obj = F.from_json("value", "struct<pages:array<string>,urls:array<string>>")
    items = F.coalesce(F.from_json("value", "array<string>"), obj["pages"], obj["urls"])
    rows = text.select(F.posexplode(items).alias("pos", "raw")).withColumn(
        "p", F.when(F.col("raw").startswith("{"), F.from_json("raw", _ITEM)).otherwise(F.from_json(F.to_json(F.struct(F.col("raw").alias("url"))), _ITEM)))
    n = F.concat(F.lit("page-"), "pos")
    return rows.select(*_page("p", F.concat(F.lit("/"), n), F.coalesce("p.content", F.lit("")), n))


def page_tree(spark: SparkSession, root: str) -> DataFrame:
    """Pages of a pages/**/meta.json tree; content.md beside it, else content.html, is the content."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")
    def whole(name: str) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(f"{root}/pages", wholetext=True).select(folder.alias("dir"), "value")
    pages = whole("meta.json").select("dir", F.coalesce(F.from_json("value", _ITEM), F.from_json(F.lit("{}"), _ITEM)).alias("p"))
    named = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "content.*").text(f"{root}/pages", wholetext=True).select(
        folder.alias("dir"), F.col("_metadata.file_name").alias("name"), "value").where(F.col("name").isin("content.md", "content.html"))
    body = named.groupBy("dir").agg(F.max_by("value", "name").alias("content"))
    rel = F.concat(F.lit("/"), F.regexp_extract("dir", r"/pages/(.*)$", 1))
    return pages.join(body, "dir", "left").select(*_page("p", rel, F.coalesce("content", F.lit("")), F.substring_index("dir", "/", -1)))


def file_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(seq, path, type, size, mtime, error) of a file listing; the header record is left out."""
    rows = spark.read.schema(S.FILE_ENTRY).json(path, mode="FAILFAST")
    return rows.where(F.col("path").isNotNull()).withColumn("seq", SEQ())


def extensions(spark: SparkSession, root: str) -> DataFrame:
    """Inventory rows of <site>/{core,plugin_list,theme_list,mu_plugins}.json trees."""
    site = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    out = None
    for kind, name in (("core", "core_version.json"), ("plugin", "plugin_list.json"), ("theme", "theme_list.json"), ("mu-plugin", "mu_plugins.json")):
        rows = spark.read.schema(S.EXTENSION).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root, multiLine=True).select(
            site.alias("site"), F.lit(kind).alias("ext_type"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def multisite(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("site").agg(F.coalesce(F.bool_or(F.col("status") == "active-network"), F.lit(False)).alias("multisite"))


def dependency_reports(spark: SparkSession, project: str, kind: str, path: str) -> DataFrame:
    """Outdated rows (project, type, package, current, latest) of a composer, npm, pip or wp report."""
    text = spark.read.text(path, wholetext=True)
    item = "struct<name:string,version:string,latest:string,latest_version:string,update_version:string>"
    if kind == "npm":
        one = "struct<current:string,latest:string>"
        rows = text.select(F.explode(F.from_json("value", MAP)).alias("package", "v")).withColumn(
            "o", F.when(F.col("v").startswith("["), F.get(F.from_json("v", f"array<{one}>"), 0)).otherwise(F.from_json("v", one))).select("package", "o.current", "o.latest")
    else:
        listed = F.from_json("value", f"struct<installed:array<{item}>>")["installed"] if kind == "composer" else F.from_json("value", f"array<{item}>")
        rows = text.select(F.inline(listed)).select(
            F.col("name").alias("package"), F.col("version").alias("current"), U.first_filled(F.col("latest_version"), F.col("update_version"), F.col("latest")).alias("latest"))
    return rows.where(F.coalesce("package", F.lit("")) != "").select(F.lit(project).alias("project"), F.lit(kind).alias("type"), "package", "current", "latest")


def audit_reports(spark: SparkSession, project: str, kind: str, path: str) -> DataFrame:
    """Advisories (project, type, package, id, title, severity) of a composer, npm or pip audit."""
    text = spark.read.text(path, wholetext=True)
    adv = "struct<id:string,cve:string,advisoryId:string,url:string,title:string,description:string,severity:string>"
    if kind == "pip":
        rows = text.select(F.inline(F.from_json("value", f"array<struct<name:string,vulns:array<{adv}>>>"))).select(F.col("name").alias("package"), F.explode("vulns").alias("a"))
    elif kind == "composer":
        rows = text.select(F.explode(F.from_json("value", "struct<advisories:map<string,string>>")["advisories"]).alias("package", "v")).select(
            "package", F.explode(F.when(F.col("v").startswith("["), F.from_json("v", f"array<{adv}>")).otherwise(
                F.map_values(F.from_json("v", f"map<string,{adv}>")))).alias("a"))
    else:
        one = "struct<severity:string,isDirect:boolean,via:array<string>>"
        v = text.select(F.explode(F.from_json("value", f"struct<vulnerabilities:map<string,{one}>>")["vulnerabilities"]).alias("package", "v"))
        via = F.filter(F.transform("v.via", lambda s: F.from_json(s, adv)), lambda a: a.isNotNull() & F.coalesce(a["title"], a["url"]).isNotNull())
        bare = F.array(F.from_json(F.lit("{}"), adv))
        rows = v.select("package", F.col("v.severity").alias("sev"), F.explode(F.when(F.size(via) > 0, via).otherwise(bare)).alias("a")).withColumn(
            "a", F.col("a").withField("severity", F.coalesce("a.severity", "sev"))).drop("sev")
    return rows.select(
        F.lit(project).alias("project"), F.lit(kind).alias("type"), "package", U.first_filled(F.col("a.cve"), F.col("a.advisoryId"), F.col("a.id"), F.col("a.url")).alias("id"),
        F.coalesce(U.first_filled(F.col("a.title"), F.col("a.description")), F.concat(F.lit("Known vulnerability in "), "package")).alias("title"),
        F.coalesce(F.col("a.severity"), F.lit("unknown")).alias("severity"))


def catalog_json(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """(locale, id, text) of a JSON catalog: an object, or a list of {id|key, text|value}."""
    text = spark.read.text(path, wholetext=True)
    m = F.col("m")
    listed = text.select(F.explode(F.from_json("value", f"array<{MAP}>")).alias("m")).select(
        _key(m, ("id", "key", "string_id", "name")).alias("id"), _key(m, ("text", "value", "translation", "string")).alias("text"))
    plain = text.select(F.explode(F.from_json("value", MAP)).alias("id", "text"))
    return listed.unionByName(plain).where("id is not null").select(F.lit(locale).alias("locale"), "id", F.coalesce("text", F.lit("")).alias("text"))


def catalog_csv(spark: SparkSession, path: str, locale: str) -> DataFrame:
    raw = _csv(spark, path, header=True)
    ident = _present(raw.columns, ("id", "key", "string_id", "stringid", "name")) or raw.columns[0]
    text = _present(raw.columns, ("text", "value", "translation", "string")) or raw.columns[1]
    return raw.select(F.lit(locale).alias("locale"), F.trim(f"`{ident}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id <> ''")


EXPORT_ITEM = ("`wp:post_id` bigint, `wp:post_type` string, `wp:attachment_url` string, `content:encoded` string, `excerpt:encoded` string, "
               "`wp:postmeta` array<struct<`wp:meta_key`:string,`wp:meta_value`:string>>")


def export_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a site export: post_id, post_type, attachment_url, content, excerpt, meta map."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(EXPORT_ITEM).load(path)
    meta = F.map_from_entries(F.transform(F.coalesce("`wp:postmeta`", F.array().cast("array<struct<`wp:meta_key`:string,`wp:meta_value`:string>>")),
                                          lambda p: F.struct(p["wp:meta_key"], p["wp:meta_value"])))
    return raw.select(F.col("`wp:post_id`").alias("post_id"), F.col("`wp:post_type`").alias("post_type"), F.col("`wp:attachment_url`").alias("attachment_url"),
                      F.col("`content:encoded`").alias("content"), F.col("`excerpt:encoded`").alias("excerpt"), meta.alias("meta"))


def attachments(items: DataFrame) -> DataFrame:
    """(attachment_id, path, metadata) of an export's attachments."""
    path = U.upload_path(U.first_filled(F.try_element_at("meta", F.lit("_wp_attached_file")), F.col("attachment_url")))
    return items.where("post_type = 'attachment'").select(
        F.col("post_id").alias("attachment_id"), path.alias("path"), F.try_element_at("meta", F.lit("_wp_attachment_metadata")).alias("metadata")).where("path <> ''")


def featured_images(items: DataFrame) -> DataFrame:
    return items.select("post_id", F.try_element_at("meta", F.lit("_thumbnail_id")).try_cast("bigint").alias("attachment_id")).where("attachment_id is not null")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses by path, from one JSON object per file."""
    value = "struct<status:int,headers:map<string,string>,body:string,durationMs:double,timedOut:boolean,error:string>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("path", "r")).select(
        "path", "r.status", "r.headers", "r.body", F.col("r.durationMs").alias("duration_ms"), F.col("r.timedOut").alias("timed_out"), "r.error")


def probe_history(spark: SparkSession, path: str) -> DataFrame:
    """(ts, host, status, checks) rows of a run history; torn lines are skipped."""
    return jsonl(spark, path, S.PROBE_RUN).select("ts", F.posexplode("results").alias("seq", "r")).select("ts", "seq", "r.host", "r.status", "r.checks")


def saved_pages(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """(url, file, html) of saved pages named by a manifest of url and file."""
    listed = spark.read.schema("url string, file string").json(manifest, multiLine=True)
    html = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("html"))
    return listed.withColumn("name", F.substring_index("file", "/", -1)).join(html, "name").select("url", "file", "html")


def catalog_snapshot(load: Callable[[str], DataFrame], database: str) -> dict[str, DataFrame]:
    """Flat catalog tables from the information_schema views that `load` reads (for example through JDBC)."""
    here = lambda view, col="TABLE_SCHEMA": load(view).where(F.col(col) == database)
    columns = here("COLUMNS")
    return {
        "databases": here("SCHEMATA", "SCHEMA_NAME").select(
            F.col("SCHEMA_NAME").alias("name"), F.col("DEFAULT_CHARACTER_SET_NAME").alias("charset"), F.col("DEFAULT_COLLATION_NAME").alias("collation")),
        "tables": here("TABLES").select(
            F.col("TABLE_NAME").alias("tbl"), F.regexp_extract("TABLE_COLLATION", "^[^_]*", 0).alias("charset"), F.col("TABLE_COLLATION").alias("collation"), F.col("ROW_FORMAT").alias("row_format")),
        "columns": columns.select(
            F.col("TABLE_NAME").alias("tbl"), F.col("COLUMN_NAME").alias("col"), F.col("DATA_TYPE").alias("data_type"), F.col("CHARACTER_SET_NAME").alias("charset"),
            F.col("COLLATION_NAME").alias("collation"), F.col("CHARACTER_MAXIMUM_LENGTH").cast("bigint").alias("length")),
        "index_parts": here("STATISTICS").select(
            F.col("TABLE_NAME").alias("tbl"), F.col("INDEX_NAME").alias("index_name"), F.col("COLUMN_NAME").alias("col"), F.col("SUB_PART").cast("bigint").alias("sub_part"),
            F.col("SEQ_IN_INDEX").alias("seq")),
        "foreign_keys": here("KEY_COLUMN_USAGE").where("REFERENCED_TABLE_NAME is not null").select(
            F.col("REFERENCED_TABLE_NAME").alias("src"), F.col("TABLE_NAME").alias("dst")).distinct(),
    }


def index_columns(index_parts: DataFrame) -> DataFrame:
    """(tbl, index_name, columns) with the columns in index order."""
    return index_parts.groupBy("tbl", "index_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "col"))), lambda s: s["col"]).alias("columns"))
