"""Link graph between pages: inbound links, orphans, adjacency, crawl frontier, link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import html as H, url as U
from fleetlens.operators.skew import lookup
from fleetlens.session import staged


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) paths of the links between two different pages of the set."""
    known = pages.select(U.relative_path(F.col("url")).alias("dst")).distinct()
    edges = staged(
        pages.select(U.relative_path(F.col("url")).alias("src"), F.explode("links").alias("link"))
        .select("src", U.relative_path(F.col("link")).alias("dst"))
        .where(F.col("src") != F.col("dst")).distinct(), "edges")
    return lookup(edges, known.withColumn("_page", F.lit(True)), "dst", ["src"], how="inner", base=edges).select("src", "dst")


def inbound_counts(pages: DataFrame) -> DataFrame:
    """Every page path with its number of linking pages, 0 included."""
    counts = page_links(pages).groupBy("dst").agg(F.count("*").alias("inbound"))
    paths = pages.select(U.relative_path(F.col("url")).alias("path")).distinct()
    return paths.join(counts, paths.path == counts.dst, "left").select(
        "path", F.coalesce("inbound", F.lit(0)).alias("inbound")
    )


def orphans(pages: DataFrame, entry_pages: list[str]) -> DataFrame:
    """Paths no other page links to, except the entry pages."""
    return inbound_counts(pages).where(
        (F.col("inbound") == 0) & ~F.col("path").isin([e for e in entry_pages])
    ).select("path")


def adjacency(pages: DataFrame, allowed: Column) -> DataFrame:
    """Distinct outgoing (src, dst) paths whose link is allowed, without self-links."""
    return (
        pages.select(U.relative_path(F.col("url")).alias("src"), F.explode("links").alias("link"))
        .where(allowed).select("src", U.relative_path(F.col("link")).alias("dst"))
        .where(F.col("src") != F.col("dst")).distinct()
    )


def admitted(
    url: Column, origins: list[str], paths: list[str] = (), denied_params: list[str] = (),
    disallowed: list[str] = (),
) -> Column:
    """Crawl admission: known origin, allowed path prefix, no denied parameter, no disallowed prefix."""
    full = U.relative_path(url)
    path = F.regexp_extract(full, r"^[^?]*", 0)
    ok = U.origin(url).isin(list(origins))
    if paths:
        hit = F.lit(False)
        for p in paths:
            hit = hit | path.startswith(p)
        ok = ok & hit
    names = F.transform(F.split(F.regexp_extract(full, r"\?(.*)$", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    for param in denied_params:
        ok = ok & ~F.array_contains(names, param)
    for prefix in disallowed:
        if prefix:
            ok = ok & ~full.startswith(prefix)
    return ok


def next_frontier(
    found: DataFrame, seen: DataFrame, admitted_cond: Column, depth_limit: int
) -> DataFrame:
    """New urls to crawl from (url, depth) of the linking page; `seen` holds visited, failed and queued urls.

    Links collapse to one row per url, with the smallest depth, before the anti-join.
    """
    fresh = (
        found.select(U.crawl_url(F.col("url")).alias("url"), (F.col("depth") + 1).alias("depth"))
        .where((F.col("depth") <= depth_limit) & (F.col("url") != "") & admitted_cond)
        .groupBy("url").agg(F.min("depth").alias("depth"))
    )
    return fresh.join(seen.select("url").distinct(), "url", "left_anti")


def image_inventory(uses: DataFrame) -> DataFrame:
    """Per image src: largest width and height, first filled alt by seq, distinct pages."""
    per_page = uses.groupBy("src", "page").agg(
        F.max("width").alias("w"), F.max("height").alias("h"),
        F.min(F.when(F.coalesce("alt", F.lit("")) != "", F.struct("seq", "alt"))).alias("a"),
    )
    return per_page.groupBy("src").agg(
        F.max("w").alias("width"), F.max("h").alias("height"), F.min("a")["alt"].alias("alt"),
        F.count("*").alias("pages"),
    )


def check_links(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Findings per (page_url, type, url) link from its recorded status (url, status, error, chain)."""
    both = lookup(links, statuses.withColumn("_known", F.lit(True)), "url", ["page_url", "type"])
    https = F.col("page_url").startswith("https:") & F.col("url").startswith("http:")
    known = F.coalesce("_known", F.lit(False))
    failed = known & F.col("error").isNotNull()
    answered = known & ~failed
    hops = F.coalesce(F.size("chain"), F.lit(0))
    rules = (
        (https & (F.col("type") == "anchor"), "warn", "insecure_link"),
        (https & (F.col("type") != "anchor"), "error", "mixed_content"),
        (~known, "warn", "no_response"),
        (failed, "warn", "request_failed"),
        (answered & (F.col("status") >= 400), "warn", "http_error"),
        (answered & (hops >= 2), "warn", "redirect_chain"),
        (answered & (hops == 1), "info", "redirect"),
    )
    hits = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"))) for cond, sev, rule in rules
    ]))
    return both.select("page_url", "type", "url", F.explode(hits).alias("f")).select(
        "page_url", "type", "url", "f.severity", "f.rule"
    )


BROKEN_RULES = ("no_response", "request_failed", "http_error")


def broken_per_page(link_findings: DataFrame, max_broken: int) -> DataFrame:
    """Pages with more broken links than allowed."""
    return (
        link_findings.where(F.col("rule").isin(*BROKEN_RULES)).groupBy("page_url")
        .agg(F.count("*").alias("broken")).where(F.col("broken") > max_broken)
    )


def typed_links(pages: DataFrame, *keys: str) -> DataFrame:
    """(*keys, type, url, raw): the distinct absolute http(s) links of each page by type, each as first written.

    `pages` has `url` and `html`. References are resolved against the page's URL, or
    against its <base href>. Only references are shuffled, once a page and
    target; the HTML stays where it is read. A null html has no links; a page without url has
    those that are absolute.
    """
    here = F.coalesce(F.col("url"), F.lit(""))
    root = H.base_href(F.col("html"))
    base = F.when(root.isNull(), here).otherwise(F.coalesce(U.resolve(here, root), here))
    refs = pages.select(*keys, base.alias("base"), F.explode(H.references(F.col("html"))).alias("r"))
    found = refs.select(*keys, "r.type", U.resolve(F.col("base"), F.col("r.raw")).alias("url"), F.struct("r.at", "r.raw").alias("r"))
    first = found.where("url IS NOT NULL").groupBy(*keys, "type", "url").agg(F.min("r").alias("r"))
    return first.select(*keys, "type", "url", "r.raw")
