"""Site audit queries: pages with a head and a tail derived from the page id, spread over six sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.plans import site_audit as A
from fleetlens.queries.registry import query, table

HEAD = (
    (2, 0, '<meta name="description" content="About {k40}">'), (3, 0, '<link rel="canonical" href="https://staging.x.test/{k}">'),
    (3, 1, "<link href='https://x.example/{k}' rel='canonical'>"), (5, 0, '<meta name=robots content="noindex,follow">'),
    (4, 0, '<meta property="og:title" content="x">'), (7, 0, '<meta name="twitter:card" content="summary">'),
    (11, 0, '<meta name="generator" content="WordPress 6.1">'), (13, 0, '<script src="http://cdn.test/a.js"></script>'),
    (17, 0, "<script>gtag('x')</script>"), (19, 0, '<link rel="shortcut icon" href="/i.ico">'),
)
TAIL = (
    (6, 0, '<img src="http://i.test/a.png">'), (6, 1, "<img src='/a.png' alt=''>"), (8, 0, '<form><input type="text" name="q"></form>'),
    (8, 1, "<label>Q <input name=q></label>"), (9, 0, '<p style="color:#777;background:#888888">x</p>'), (10, 0, "<p>Lorem  Ipsum</p>"),
    (12, 0, '<a href="/lost/{k40}">gone</a>'), (14, 0, "<nav></nav>"), (15, 0, "<b>Warning</b>: x"), (16, 0, "<style>a:focus{outline:none}</style>"),
)


def _fragments(k: Column, parts: tuple) -> Column:
    def one(mod: int, rest: int, text: str) -> Column:
        body = F.replace(F.replace(F.lit(text), F.lit("{k40}"), (k % 40).cast("string")), F.lit("{k}"), k.cast("string"))
        return F.when(k % mod == rest, body).otherwise("")
    return F.concat(*[one(*p) for p in parts])


def pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    site = F.concat(F.lit("s"), k % 6)
    html = F.concat(F.replace("html", F.lit("</head>"), F.concat(_fragments(k, HEAD), F.lit("</head>"))), _fragments(k, TAIL))
    headers = F.when(k % 6 < 3, F.create_map(F.lit("X-Frame-Options"), F.lit("DENY"), F.lit("Strict-Transport-Security"), F.lit("max-age=1"))).otherwise(
        F.create_map(F.lit("x-content-type-options"), F.lit("NoSniff"), F.lit("Content-Security-Policy"), F.lit("frame-ancestors 'none'")))
    return table(spark, d, "pages").select(
        site.alias("site"), F.concat(F.lit("https://"), site, F.lit(".test/"), F.when(k < 6, "").otherwise(F.concat(F.lit("p/"), k))).alias("url"),
        html.alias("html"), headers.alias("headers"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") % 6
    return table(spark, d, "nation").select(
        F.concat(F.lit("s"), n).alias("site"), F.concat(F.lit("https://s"), n, F.lit(".test")).alias("base_url"),
        F.when(n % 2 == 0, "production").otherwise("staging").alias("environment")).distinct()


def resources(spark: SparkSession, d: str) -> DataFrame:
    """25 nations: six sites by the remainder of 6, one path per quotient; status from the key, and lost pages."""
    k = F.col("n_nationkey")
    path = F.element_at(F.array(*[F.lit(p) for p in ("/robots.txt", "/sitemap.xml", "http:/", "/wp-json/wp/v2/users", "/favicon.ico")]), (F.floor(k / 6) + 1).cast("int"))
    body = F.when(k < 6, F.lit("User-agent: *\nDisallow: /\n")).when(F.floor(k / 6) == 3, F.lit('[{"slug": "Admin"}]')).otherwise("")
    fixed = table(spark, d, "nation").select(
        F.concat(F.lit("s"), k % 6).alias("site"), path.alias("path"), F.when(F.floor(k / 6) == 2, 301).when(k % 4 == 1, 404).otherwise(200).alias("status"),
        F.create_map(F.lit("Location"), F.when(k % 4 == 2, "http://x").otherwise("https://x")).alias("headers"), body.alias("body"))
    p = F.col("page_id")
    lost = table(spark, d, "pages").where("page_id % 12 = 0").select(
        F.concat(F.lit("s"), p % 6).alias("site"), F.concat(F.lit("/lost/"), p % 40).alias("path"), F.when(p % 8 == 0, 500).otherwise(200).alias("status"),
        F.lit("").alias("body")).distinct()
    return fixed.unionByName(lost, allowMissingColumns=True)


BASE = """
p AS (SELECT page_id AS k, 's' || page_id % 6 AS site, 'https://s' || page_id % 6 || '.test/' || CASE WHEN page_id < 6 THEN '' ELSE 'p/' || page_id END AS url, page_id % 6 % 2 = 0 AS prod,
   lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))) AS title FROM pages),
st AS (SELECT DISTINCT n_nationkey % 6 AS n, 's' || n_nationkey % 6 AS site, n_nationkey % 6 % 2 = 0 AS prod FROM nation),
rs AS (SELECT n_nationkey AS k, n_nationkey % 6 AS n, n_nationkey // 6 AS q, CASE WHEN n_nationkey // 6 = 2 THEN 301 WHEN n_nationkey % 4 = 1 THEN 404 ELSE 200 END AS status FROM nation)"""


def _select(df: DataFrame) -> DataFrame:
    return df.select(F.col("entity_id").alias("entity"), "rule", "severity")


@query("seo_findings", f"""
WITH {BASE}
SELECT url AS entity, 'missing-meta-description' AS rule, 'warning' AS severity FROM p WHERE k % 2 = 1
UNION ALL SELECT url, 'missing-title', 'blocker' FROM p WHERE title = ''
UNION ALL SELECT url, 'missing-canonical', 'warning' FROM p WHERE k % 3 = 2
UNION ALL SELECT url, 'staging-canonical', 'blocker' FROM p WHERE k % 3 = 0
UNION ALL SELECT url, 'noindex-production', 'blocker' FROM p WHERE k % 5 = 0 AND prod
UNION ALL SELECT url, 'noindex-staging-ok', 'info' FROM p WHERE k % 5 = 0 AND NOT prod
UNION ALL SELECT url, 'staging-indexable', 'warning' FROM p WHERE k % 5 <> 0 AND NOT prod
UNION ALL SELECT url, 'missing-open-graph', 'warning' FROM p WHERE k % 4 <> 0
UNION ALL SELECT url, 'missing-twitter-card', 'info' FROM p WHERE k % 7 <> 0
UNION ALL SELECT min(url), 'duplicate-title', 'warning' FROM p WHERE title <> '' GROUP BY site, title HAVING count(*) > 1
UNION ALL SELECT min(url), 'duplicate-meta-description', 'warning' FROM p WHERE k % 2 = 0 GROUP BY site, k % 40 HAVING count(*) > 1
UNION ALL SELECT 's' || n, 'missing-robots-txt', 'warning' FROM rs WHERE q = 0 AND status <> 200
UNION ALL SELECT 's' || n, 'robots-disallow-all', 'blocker' FROM rs WHERE q = 0 AND status = 200 AND n % 2 = 0
UNION ALL SELECT 's' || n, 'missing-sitemap', 'warning' FROM rs WHERE q = 1 AND status <> 200""")
def seo_findings(spark: SparkSession, d: str) -> DataFrame:
    return _select(A.seo(A.facts(pages(spark, d)), sites(spark, d), resources(spark, d)))


@query("accessibility_findings", f"""
WITH {BASE}
SELECT url AS entity, 'img-missing-alt' AS rule, 'blocker' AS severity FROM p WHERE k % 6 = 0
UNION ALL SELECT url, 'form-missing-label', 'blocker' FROM p WHERE k % 8 = 0
UNION ALL SELECT url, 'low-contrast', 'warning' FROM p WHERE k % 9 = 0
UNION ALL SELECT url, 'focus-outline-removed', 'warning' FROM p WHERE k % 16 = 0""")
def accessibility_findings(spark: SparkSession, d: str) -> DataFrame:
    return _select(A.accessibility(A.facts(pages(spark, d))))


@query("security_findings", f"""
WITH {BASE}, home AS (SELECT * FROM p WHERE k < 6)
SELECT url AS entity, 'mixed-content-active' AS rule, 'blocker' AS severity FROM p WHERE k % 13 = 0
UNION ALL SELECT url, 'mixed-content-passive', 'warning' FROM p WHERE k % 6 = 0
UNION ALL SELECT url, 'wp-version-exposed', 'warning' FROM p WHERE k % 11 = 0
UNION ALL SELECT url, 'debug-output', 'blocker' FROM p WHERE k % 15 = 0
UNION ALL SELECT url, 'missing-hsts', 'warning' FROM home WHERE k >= 3
UNION ALL SELECT url, 'missing-x-content-type-options', 'warning' FROM home WHERE k < 3
UNION ALL SELECT url, 'missing-referrer-policy', 'info' FROM home
UNION ALL SELECT 's' || n, 'no-https-redirect', 'blocker' FROM rs WHERE q = 2 AND k % 4 = 2
UNION ALL SELECT site, 'xmlrpc-state', 'info' FROM st
UNION ALL SELECT 's' || n, 'default-admin-username', 'warning' FROM rs WHERE q = 3 AND status = 200""")
def security_findings(spark: SparkSession, d: str) -> DataFrame:
    return _select(A.security(A.facts(pages(spark, d)), sites(spark, d), resources(spark, d)))


@query("content_findings", f"""
WITH {BASE}, lost AS (SELECT site, k % 40 AS l, max(CASE WHEN k % 8 = 0 THEN 500 ELSE 200 END) AS status FROM p WHERE k % 12 = 0 GROUP BY 1, 2)
SELECT url AS entity, 'lorem-ipsum' AS rule, 'blocker' AS severity FROM p WHERE k % 10 = 0
UNION ALL SELECT url, 'empty-menu', 'warning' FROM p WHERE k % 14 = 0
UNION ALL SELECT min(p.url), 'broken-internal-link', 'warning' FROM p JOIN lost ON p.site = lost.site AND p.k % 40 = lost.l WHERE p.k % 12 = 0 AND lost.status >= 400 GROUP BY p.site, lost.l
UNION ALL SELECT site, 'missing-favicon', 'warning' FROM st WHERE site NOT IN (SELECT site FROM p WHERE k % 19 = 0) AND n NOT IN (SELECT n FROM rs WHERE q = 4 AND status = 200)
UNION ALL SELECT site, '404-wrong-status', 'warning' FROM st""")
def content_findings(spark: SparkSession, d: str) -> DataFrame:
    return _select(A.content(A.facts(pages(spark, d)), sites(spark, d), resources(spark, d)))


@query("analytics_findings", f"""
WITH {BASE}
SELECT site AS entity, CASE WHEN site IN (SELECT site FROM p WHERE k % 17 = 0) THEN 'tracking-present' ELSE 'tracking-missing' END AS rule,
  CASE WHEN site IN (SELECT site FROM p WHERE k % 17 = 0) THEN 'info' WHEN prod THEN 'blocker' ELSE 'warning' END AS severity FROM st
UNION ALL SELECT site, 'consent-missing', 'blocker' FROM st""")
def analytics_findings(spark: SparkSession, d: str) -> DataFrame:
    return _select(A.analytics(A.facts(pages(spark, d)), sites(spark, d), consent_required=True))


@query("perf_budget", """
WITH s AS (SELECT 'u' || user_id % 10 AS site, CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS form,
  CASE event_type WHEN 'click' THEN 'lcp_ms' WHEN 'view' THEN 'tbt_ms' WHEN 'error' THEN 'cls' ELSE 'performance_score' END AS metric,
  CASE event_type WHEN 'click' THEN value * 9 WHEN 'view' THEN value WHEN 'error' THEN value / 2400 ELSE value / 290 END AS value FROM events),
m AS (SELECT site, form, metric, median(value) AS med FROM s GROUP BY 1, 2, 3),
j AS (SELECT *, CASE form || metric WHEN 'mobilelcp_ms' THEN 2500 WHEN 'mobilecls' THEN 0.1 WHEN 'mobiletbt_ms' THEN 300 WHEN 'mobileperformance_score' THEN 0.8
  WHEN 'desktoplcp_ms' THEN 1800 WHEN 'desktopcls' THEN 0.1 WHEN 'desktoptbt_ms' THEN 200 ELSE 0.9 END::DOUBLE AS lim FROM m),
o AS (SELECT *, CASE WHEN metric = 'performance_score' THEN med < lim ELSE med > lim END AS over FROM j)
SELECT site, form, CASE WHEN metric = 'performance_score' THEN form || '-score-under-budget' ELSE form || '-' || metric || '-over-budget' END AS rule,
  CASE WHEN CASE WHEN metric = 'performance_score' THEN med < lim - 0.15::DOUBLE ELSE med / lim > 1.25 END THEN 'blocker' ELSE 'warning' END AS severity, med AS median FROM o WHERE over
UNION ALL SELECT site, form, form || '-within-budget', 'info', NULL FROM o GROUP BY site, form HAVING NOT bool_or(over)""")
def perf_budget(spark: SparkSession, d: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    return A.performance(table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("site"), F.when(F.col("event_id") % 2 == 0, "mobile").otherwise("desktop").alias("form"),
        F.when(t == "click", "lcp_ms").when(t == "view", "tbt_ms").when(t == "error", "cls").otherwise("performance_score").alias("metric"),
        F.when(t == "click", v * 9).when(t == "view", v).when(t == "error", v / 2400).otherwise(v / 290).alias("value")))
