"""URL rules whose decisions reach the aliases of a URL. DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions.html import base_href, decode_entities
from fleetlens.functions.url import resolve
from fleetlens.llm.common import carried, let, lower_ascii, quoted
from fleetlens.llm.components import components
from fleetlens.session import staged

#: Parts into which the rows of one host suffix are dealt when rules are joined by shuffle.
SPREAD = 32


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty when there is none."""
    return let(url, lambda u: F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.char_length(u)))
               .otherwise(F.lit("")))


def host_of(url: Column) -> Column:
    return let(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), lower_ascii)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What a URL names: host in lower case, path and query; scheme and fragment don't count. Null when it names nothing.

    Of http(s) URLs all spellings have one name: dot segments are carried out,
    default ports go, an empty path is `/`, and what is not plain ASCII is escaped.
    """
    tail = lambda u: F.regexp_extract(_rest(u), r"^[^/?#]*([^#]*)", 1)
    return let(F.coalesce(resolve(url, F.lit("")), url), lambda u: F.when(F.instr(u, "://") > 0, F.concat(host_of(u), tail(u))))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule_verdict) from (verdict, host, path) triples."""
    if not rules:
        return spark.sql("SELECT '' AS rule_host, '' AS rule_path, '' AS rule_verdict WHERE false")
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical link or refresh redirect declares to be the same resource.

    Targets are decoded (`&amp;`) and resolved against the page's URL, or against its <base
    href>: absolute ones, `//host/path`, `/path`, `page`, `../page`, `?query`. What is not http(s)
    is no link. Pages without url or html give none; very long pages are read whole, and
    only their targets are handed on.
    """
    body, here = F.coalesce(quoted(html), F.lit("")), quoted(url)
    canonical = F.transform(
        F.filter(F.regexp_extract_all(body, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)),
                 lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")),
        lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    refresh = F.transform(
        F.filter(F.regexp_extract_all(body, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)),
                 lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")),
        lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    root = base_href(body)
    base = F.when(root.isNull(), here).otherwise(F.coalesce(resolve(here, root), here))
    found = pages.where(here.isNotNull()).select(here.alias("url"), base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("to"))
    found = found.where("to <> ''").select("url", resolve(F.col("base"), decode_entities(F.col("to"))).alias("to")).where("to IS NOT NULL")
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the distinct (host, path) of `urls` that a rule fits: the longest, then the smallest.

    Each host is looked up by its endings, no more of them than the deepest rule has
    labels. The rows of an ending are dealt over SPREAD parts, so `com` is not one
    task; whether the rules are small enough to broadcast is left to their size.
    """
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    first = F.greatest(F.size("labels") - F.lit(depth) + 1, F.lit(1))
    endings = F.transform(F.sequence(first, F.size("labels")),
                          lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    asked = urls.select("host", "path").where("host <> ''").distinct().withColumn("labels", labels)
    asked = asked.select("host", "path", F.explode(endings).alias("rule_host"),
                         F.pmod(F.xxhash64("host", "path"), F.lit(SPREAD)).alias("part"))
    dealt = rules.distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    rule = F.concat("rule_host", "rule_path")
    best = F.struct((-F.char_length(rule)).alias("n"), rule.alias("rule"), F.col("rule_verdict"))
    hits = asked.join(dealt, ["rule_host", "part"]).where(F.expr("startswith(path, rule_path)"))
    return hits.groupBy("host", "path").agg(F.min(best).alias("best")).select("host", "path", "best.rule", "best.rule_verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, url: str = "url",
                 default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower
    case; path: from there up to `?`, `#` or the end. A null url and one without
    `://` have both empty. A rule fits its host and all subdomains when the path
    starts with the rule's; the longest rule decides, and is given as host and path.

    `links` (a, b) are pairs of nodes that are the same resource: redirects and
    canonical links. Their connected components are classes of aliases. A page with
    no rule of its own takes its class's decision: allow when a rule allows any
    member, else block when a rule blocks any member, crawled or not; else `default`.

    Repeated rows repeat their result; rules given twice count once, and of two
    rules alike in host and path the one with the smaller verdict (allow) holds.
    Null links are ignored. Input columns named like the new ones are replaced.
    """
    names = carried(pages, ("host", "path", "rule", "verdict"))
    here = quoted(url)
    rows = pages.select(*[quoted(c) for c in names], host_of(F.coalesce(here, F.lit(""))).alias("host"),
                        path_of(F.coalesce(here, F.lit(""))).alias("path"), node_of(here).alias("_llm_node"))
    rules = staged(rules, "rules")
    judged = rows.join(matched(rows, rules), ["host", "path"], "left")
    known = None
    if links is not None:
        known = staged(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "aliases")
        known = known if known.limit(1).count() else None
    if known is None:
        shared = judged.withColumn("_llm_shared", F.lit(None).cast("string"))
    else:
        classes = staged(components(known), "classes")
        parts = classes.select("node", "component", host_of(F.concat(F.lit("x://"), "node")).alias("host"),
                               path_of(F.concat(F.lit("x://"), "node")).alias("path"))
        ruled = parts.join(matched(parts, rules), ["host", "path"])
        decision = ruled.groupBy("component").agg(F.min("rule_verdict").alias("_llm_shared"))
        alias = classes.join(decision, "component").select(F.col("node").alias("_llm_node"), "_llm_shared")
        shared = judged.join(alias, "_llm_node", "left")
    verdict = F.coalesce("rule_verdict", "_llm_shared", F.lit(default))
    return shared.select(*[quoted(c) for c in names], "host", "path", "rule", verdict.alias("verdict"))
