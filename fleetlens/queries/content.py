"""Page and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions import html as H, text as X, url as U
from fleetlens.operators.findings import by_priority
from fleetlens.operators import blocks, dom, duplicates, findings as FD, links, media
from fleetlens.operators.parts import dealt, tasks
from fleetlens.plans import freshness
from fleetlens.queries.registry import query, table



def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with title, headings, dates and links derived from the stored HTML and the page id."""
    p = table(spark, d, "pages")
    pid = F.col("page_id")
    level = lambda k: F.concat(F.lit("H"), (F.floor(pid / k) % 4 + 1).cast("int"), F.lit(": part"))
    return p.select(
        F.concat(F.lit("https://site.test/p/"), pid).alias("url"),
        F.when(pid % 10 == 0, F.lit(" Shared Title ")).when(pid % 10 == 1, F.concat(F.lit("Title "), pid % 40)).otherwise(
            F.concat(F.lit("Page "), pid)).alias("title"),
        F.when(pid % 4 == 0, F.concat(F.lit("About "), pid % 50)).otherwise(F.lit("")).alias("meta_desc"),
        F.when(pid % 6 == 0, F.lit(None)).when(pid % 6 == 1, F.lit("soon")).otherwise(
            F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (pid % 700).cast("int")), "yyyy-MM-dd")).alias("date"),
        F.when(pid % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(level(1), level(4), level(16))).alias("headings"),
        F.col("html").alias("content"),
        F.array(F.concat(F.lit("/p/"), F.floor(pid * 7 / 10)), F.concat(F.lit("https://site.test/p/"), pid, F.lit("#top"))).alias("links"),
        F.lit("").alias("slug"), pid.alias("page_id"),
    )


CONFIG = freshness.Config(
    freshness_days=365, thin_words=60, entry_pages=["/p/0", "/p/1"],
    rules=[freshness.PathRule(r"^/p/1\d$", freshness_days=30), freshness.PathRule(r"^/p/\d$", exclude=False, thin_words=5),
           freshness.PathRule(r"5$", exclude=True)],
)
NOW = "2024-06-01T12:00:00Z"

PAGES = """
raw AS (SELECT page_id AS pid, '/p/' || page_id AS path, html,
  CASE WHEN page_id % 10 = 0 THEN 'shared title' WHEN page_id % 10 = 1 THEN 'title ' || page_id % 40 ELSE 'page ' || page_id END AS tkey,
  CASE WHEN page_id % 4 = 0 THEN 'about ' || page_id % 50 ELSE '' END AS dkey,
  CASE WHEN page_id % 6 <= 1 THEN NULL ELSE DATE '2023-01-01' + CAST(page_id % 700 AS INT) END AS date,
  CASE WHEN page_id % 9 = 0 THEN [] ELSE [page_id % 4 + 1, page_id // 4 % 4 + 1, page_id // 16 % 4 + 1] END AS lv,
  trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS bare
  FROM pages),
pg AS (SELECT *, CASE WHEN bare = '' THEN 0 ELSE len(string_split(bare, ' ')) END AS words,
  CASE WHEN regexp_matches(path, '^/p/1\\d$') THEN 30 ELSE 365 END AS fresh,
  CASE WHEN regexp_matches(path, '^/p/\\d$') THEN 5 ELSE 60 END AS thin,
  (epoch_ms(TIMESTAMP '2024-06-01 12:00:00') - epoch_ms(CAST(date AS TIMESTAMP))) / 86400000.0 AS age
  FROM raw WHERE NOT regexp_matches(path, '5$')),
edges AS (SELECT DISTINCT src, dst FROM (SELECT path AS src, '/p/' || (pid * 7) // 10 AS dst FROM pg) WHERE src <> dst AND dst IN (SELECT path FROM pg)),
found AS (
  SELECT path, 'unknown_date' AS rule, 10 AS score FROM pg WHERE age IS NULL
  UNION ALL SELECT path, 'stale_content', 50 FROM pg WHERE age > fresh
  UNION ALL SELECT path, 'thin_content', 30 FROM pg WHERE words < thin
  UNION ALL SELECT path, 'no_headings', 20 FROM pg WHERE len(lv) = 0
  UNION ALL SELECT path, 'missing_h1', 40 FROM pg WHERE len(lv) > 0 AND NOT list_contains(lv, 1)
  UNION ALL SELECT path, 'multiple_h1s', 40 FROM pg WHERE len(list_filter(lv, lambda x: x = 1)) > 1
  UNION ALL SELECT path, 'non_sequential_headings', 20 FROM pg WHERE len(lv) > 0 AND lv[2] > lv[1] + 1
  UNION ALL SELECT path, 'non_sequential_headings', 20 FROM pg WHERE len(lv) > 0 AND lv[3] > lv[2] + 1
  UNION ALL SELECT path, 'duplicate_title', 80 FROM pg WHERE tkey IN (SELECT tkey FROM pg GROUP BY tkey HAVING count(*) > 1)
  UNION ALL SELECT path, 'duplicate_description', 60 FROM pg WHERE dkey <> '' AND dkey IN (SELECT dkey FROM pg GROUP BY dkey HAVING count(*) > 1)
  UNION ALL SELECT path, 'orphan_page', 100 FROM pg WHERE path NOT IN (SELECT dst FROM edges) AND path NOT IN ('/p/0', '/p/1'))
"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return freshness.findings(pages(spark, d), CONFIG, NOW)


@query("freshness_findings", f"WITH {PAGES} SELECT path AS entity_id, rule, score FROM found")
def freshness_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("entity_id", "rule", "score")


@query("freshness_priorities", f"WITH {PAGES} SELECT path AS entity_id, CAST(sum(score) AS BIGINT) AS priority, count(*) AS findings FROM found GROUP BY 1")
def freshness_priorities(spark: SparkSession, d: str) -> DataFrame:
    return freshness.priorities(_findings(spark, d))


@query("freshness_order", f"""
WITH {PAGES}, p AS (SELECT path AS entity_id, CAST(sum(score) AS BIGINT) AS priority FROM found GROUP BY 1)
SELECT entity_id, priority, row_number() OVER (ORDER BY priority DESC, entity_id) AS place FROM p""")
def freshness_order(spark: SparkSession, d: str) -> DataFrame:
    return by_priority(freshness.priorities(_findings(spark, d))).select("entity_id", "priority", "place")


@query("freshness_compare", f"""
WITH {PAGES},
cur AS (SELECT DISTINCT path, rule FROM found),
prev AS (SELECT DISTINCT CASE WHEN rule = 'stale_content' THEN path || 'x' ELSE path END AS path, rule FROM found WHERE rule <> 'thin_content')
SELECT coalesce(c.path, p.path) AS entity_id, coalesce(c.rule, p.rule) AS rule,
       CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'resolved' ELSE 'unchanged' END AS state
FROM cur c FULL JOIN prev p ON c.path = p.path AND c.rule = p.rule""")
def freshness_compare(spark: SparkSession, d: str) -> DataFrame:
    now = _findings(spark, d)
    earlier = now.where("rule <> 'thin_content'").withColumn(
        "entity_id", F.when(F.col("rule") == "stale_content", F.concat("entity_id", F.lit("x"))).otherwise(F.col("entity_id")))
    return FD.compare_runs(now, earlier, ["entity_id", "rule"])


@query("severity_matrix", f"""
WITH {PAGES}
SELECT coalesce(rule, '(all)') AS category, severity, count(*) AS n FROM (
  SELECT rule, CASE score WHEN 100 THEN 'Critical' WHEN 80 THEN 'High' WHEN 60 THEN 'Medium-High' WHEN 30 THEN 'Medium-Low'
    WHEN 50 THEN 'Medium' WHEN 40 THEN 'Medium' ELSE 'Low' END AS severity FROM found)
GROUP BY GROUPING SETS ((rule, severity), (severity))""")
def severity_matrix(spark: SparkSession, d: str) -> DataFrame:
    return FD.severity_matrix(_findings(spark, d))


@query("severity_gate", f"""
WITH {PAGES} SELECT count(*) FILTER (score >= 80) > 0 AS failed, count(*) FILTER (score >= 80) AS n_at_or_above FROM found""")
def severity_gate(spark: SparkSession, d: str) -> DataFrame:
    return FD.gate(_findings(spark, d), FD.SEVERITY_ORDER["freshness"], "High")


@query("orphan_pages", f"WITH {PAGES} SELECT path FROM found WHERE rule = 'orphan_page'")
def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    active = freshness.active_pages(pages(spark, d), CONFIG)
    return links.orphans(active, ["/p/0", "/p/1"])


@query("inbound_counts", f"""
WITH {PAGES} SELECT p.path, count(e.src) AS inbound FROM pg p LEFT JOIN edges e ON e.dst = p.path GROUP BY 1""")
def inbound_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.inbound_counts(freshness.active_pages(pages(spark, d), CONFIG))


@query("link_adjacency", """
SELECT DISTINCT '/p/' || page_id AS src, '/p/' || (page_id * 7) // 10 AS dst FROM pages WHERE page_id <> (page_id * 7) // 10""")
def link_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return links.adjacency(pages(spark, d), F.col("link").rlike("^(/|https://site.test)"))


@query("heading_skip", f"""
WITH {PAGES}, w AS (SELECT path, unnest(lv) AS level, generate_subscripts(lv, 1) AS pos FROM pg),
l AS (SELECT *, lag(level) OVER (PARTITION BY path ORDER BY pos) AS prev FROM w)
SELECT path, prev AS "from", level AS "to" FROM l WHERE level > prev + 1""")
def heading_skip(spark: SparkSession, d: str) -> DataFrame:
    active = freshness.active_pages(pages(spark, d), CONFIG)
    return active.select("path", F.explode(freshness.heading_skips(F.col("headings"))).alias("s")).select("path", "s.from", "s.to")


@query("path_rules", f"WITH {PAGES} SELECT path, fresh AS freshness_days, thin AS thin_words, path IN ('/p/0', '/p/1') AS is_entry FROM pg")
def path_rules(spark: SparkSession, d: str) -> DataFrame:
    return freshness.active_pages(pages(spark, d), CONFIG).select(
        "path", F.col("freshness_days").cast("int").alias("freshness_days"), "thin_words", "is_entry")


@query("word_count", """
SELECT doc_id, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, ' ')) END AS words FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\\s\\x{00a0}\\x{feff}]+', ' ', 'g')) AS b FROM documents)""")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("duplicate_text", """
SELECT sha256(k) AS group_id, count(*) AS n, min(doc_id) AS first_member, max(doc_id) AS last_member FROM (
  SELECT doc_id, lower(regexp_replace(text, '^[\\s\\x{00a0}\\x{feff}]+|[\\s\\x{00a0}\\x{feff}]+$', '', 'g')) AS k FROM documents)
WHERE k <> '' GROUP BY k HAVING count(*) > 1""")
def duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_groups(table(spark, d, "documents"), X.text_key(F.col("text")), "doc_id")


@query("duplicate_members", """
WITH t AS (SELECT doc_id, sha256(lower(regexp_replace(text, '^[\\s\\x{00a0}\\x{feff}]+|[\\s\\x{00a0}\\x{feff}]+$', '', 'g'))) AS group_id FROM documents)
SELECT doc_id, group_id, n, first_member FROM t JOIN (
  SELECT group_id, count(*) AS n, min(doc_id) AS first_member FROM t GROUP BY 1 HAVING count(*) > 1) USING (group_id)""")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_members(table(spark, d, "documents"), X.text_key(F.col("text")), "doc_id")


@query("page_facts", """
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
       len(regexp_extract_all(html, '(?is)<h1\\b[^>]*>.*?</h1>')) AS n_h1, len(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) AS n_anchors,
       len(regexp_extract_all(html, '(?i)<script\\b')) AS n_scripts, regexp_matches(html, '(?i)<nav\\b') AS has_nav,
       length(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'),
         '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))) AS text_length
FROM pages""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", H.title(h).alias("title"), F.size(H.inner_texts(h, "h1")).alias("n_h1"),
        F.size(H.anchors(h)).alias("n_anchors"), F.size(H.tags(h, "script")).alias("n_scripts"),
        F.array_contains(H.landmarks(h), "nav").alias("has_nav"), F.length(H.strip_tags(h)).alias("text_length"),
    )


@query("thin_pages", f"WITH {PAGES} SELECT path, words FROM pg WHERE words < thin")
def thin_pages(spark: SparkSession, d: str) -> DataFrame:
    active = freshness.active_pages(pages(spark, d), CONFIG)
    return active.select("path", X.word_count(F.col("content")).alias("words"), "thin_words").where(
        "words < thin_words").select("path", "words")


@query("tag_census", """
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag""")
def tag_census(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    per_page = table(spark, d, "pages").select("page_id", F.explode(found).alias("tag")).groupBy(
        F.lower("tag").alias("tag"), "page_id").agg(F.count("*").alias("c"))
    return per_page.groupBy("tag").agg(F.sum("c").alias("n"), F.count("*").alias("pages"))


@query("url_normalise", """
WITH s AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
b AS (SELECT page_id, regexp_replace(u, '^https?://[^/?#]*', '') AS bare, u FROM s),
c AS (SELECT *, CASE WHEN split_part(bare, '?', 1) = '' THEN '/' WHEN split_part(bare, '?', 1) = '/' THEN '/' ELSE regexp_replace(split_part(bare, '?', 1), '/+$', '') END AS p,
  array_to_string(list_sort(list_filter(string_split(split_part(bare, '?', 2), '&'), lambda x: x <> '')), '&') AS q FROM b)
SELECT page_id, CASE WHEN bare = '' THEN '/' ELSE bare END AS relative_path, p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS compare_path,
       regexp_replace(regexp_extract(list_filter(string_split(split_part(bare, '?', 1), '/'), lambda x: x <> '')[-1], '.*'), '\\.[^/.]+$', '') AS slug
FROM c""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", U.relative_path(u).alias("relative_path"), U.compare_path(u).alias("compare_path"), U.slug(u).alias("slug"))


@query("host_domain", """
SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(*) AS pages FROM (
  SELECT regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages) GROUP BY 1, 2""")
def host_domain(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(U.host(F.col("url")).alias("host"))
    return hosts.groupBy("host", U.registered_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("pages"))


@query("frontier_next", """
WITH f AS (SELECT 'https://site.test/p/' || (page_id * 7) // 10 AS url, 1 + page_id % 3 AS depth FROM pages),
seen AS (SELECT 'https://site.test/p/' || page_id AS url FROM pages WHERE page_id % 2 = 0)
SELECT url, min(depth) AS depth FROM f WHERE depth <= 2 AND url NOT IN (SELECT url FROM seen) AND NOT starts_with(url, 'https://site.test/p/9') GROUP BY 1""")
def frontier_next(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    found = p.select(F.concat(F.lit("https://SITE.test/p/"), F.floor(F.col("page_id") * 7 / 10), F.lit("#x")).alias("url"),
                     (F.col("page_id") % 3).alias("depth"))
    seen = p.where("page_id % 2 = 0").select(F.concat(F.lit("https://site.test/p/"), "page_id").alias("url"))
    ok = links.admitted(F.col("url"), ["https://site.test"], ["/p/"], ["session"], ["/p/9"])
    return links.next_frontier(found, seen, ok, 2)


@query("image_inventory", """
SELECT 'img' || l_partkey AS src, max(l_quantity) AS width, max(l_extendedprice) AS height,
       arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag <> 'N') AS alt, count(DISTINCT l_orderkey) AS pages
FROM lineitem GROUP BY 1""")
def image_inventory(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return links.image_inventory(li.select(
        F.concat(F.lit("img"), "l_partkey").alias("src"), F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("width"),
        F.col("l_extendedprice").alias("height"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("alt"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


@query("link_findings", """
WITH l AS (SELECT 'https://site.test/p/' || page_id AS page_url, CASE page_id % 3 WHEN 0 THEN 'image' ELSE 'anchor' END AS type,
       CASE WHEN page_id % 5 = 0 THEN 'http://' ELSE 'https://' END || 'cdn.test/' || page_id % 50 AS url, page_id % 50 AS k FROM pages),
s AS (SELECT DISTINCT url, CASE WHEN k % 10 = 3 THEN 404 ELSE 200 END AS status, k % 10 = 4 AS err, k % 3 AS hops FROM l WHERE k % 10 <> 7),
j AS (SELECT l.*, s.url IS NOT NULL AS known, status, err, hops FROM l LEFT JOIN s USING (url))
SELECT page_url, type, url, 'warn' AS severity, 'insecure_link' AS rule FROM j WHERE starts_with(url, 'http:') AND type = 'anchor'
UNION ALL SELECT page_url, type, url, 'error', 'mixed_content' FROM j WHERE starts_with(url, 'http:') AND type <> 'anchor'
UNION ALL SELECT page_url, type, url, 'warn', 'no_response' FROM j WHERE NOT known
UNION ALL SELECT page_url, type, url, 'warn', 'request_failed' FROM j WHERE known AND err
UNION ALL SELECT page_url, type, url, 'warn', 'http_error' FROM j WHERE known AND NOT err AND status >= 400
UNION ALL SELECT page_url, type, url, 'warn', 'redirect_chain' FROM j WHERE known AND NOT err AND hops >= 2
UNION ALL SELECT page_url, type, url, 'info', 'redirect' FROM j WHERE known AND NOT err AND hops = 1""")
def link_findings(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id")
    k = pid % 50
    found = table(spark, d, "pages").select(
        F.concat(F.lit("https://site.test/p/"), pid).alias("page_url"), F.when(pid % 3 == 0, "image").otherwise("anchor").alias("type"),
        F.concat(F.when(pid % 5 == 0, "http://").otherwise("https://"), F.lit("cdn.test/"), k).alias("url"), k.alias("k"))
    statuses = found.where("k % 10 <> 7").select(
        "url", F.when(F.col("k") % 10 == 3, 404).otherwise(200).alias("status"),
        F.when(F.col("k") % 10 == 4, "reset").alias("error"),
        F.array_repeat(F.lit("https://hop.test/"), (F.col("k") % 3).cast("int")).alias("chain")).distinct()
    return links.check_links(found.drop("k"), statuses)


# Every page gets references of each kind besides its own: up a folder with a query in character references, the query alone, another
# host without scheme, dot segments, an escape, and some that are no links; every fourth has a <base>.
EXTRA_LINKS = (
    """<a class=x href="../up/{n}?a=1&amp;b={n}#x">u</a><a href='?q={k}'>q</a><a HREF=HTTP://WWW.Example.COM:80>w</a><a href="#top">t</a>"""
    """<a href="mailto:a@b.example">m</a><a href="../../../../x/./y/..">d</a><img src=//cdn{k}.example.org/i.png alt=""><img src="a b.png">"""
    """<script src="./js/../app.js?v=%7B"></script><link rel="alternate stylesheet" href="css/%2e%2E/s.css"><link rel=icon href="/i.ico">""")
BASE_TAG = """<base href="/root/dir/index.html?z#f">"""


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id")
    extra = F.lit(EXTRA_LINKS)
    for name, value in (("{n}", pid), ("{k}", pid % 7)):
        extra = F.replace(extra, F.lit(name), value.cast("string"))
    base = F.when(pid % 4 == 0, F.lit(BASE_TAG)).otherwise("")
    return table(spark, d, "pages").select("page_id", "url", F.concat(base, F.col("html"), extra).alias("html"))


_SQL_EXTRA = EXTRA_LINKS.replace("'", "''")
_ATTR = """regexp_replace(regexp_extract(t, '(?i)(?:^|[\\s"''])NAME\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""
_TAGS = "SELECT page_id, base, '{0}' AS type, unnest(regexp_extract_all(html, '(?i)<{1}\\b([^>]*)>', 1)) AS t, " \
        "generate_subscripts(regexp_extract_all(html, '(?i)<{1}\\b([^>]*)>', 1), 1) AS nr FROM p"


@query("typed_links", """
WITH p AS (
  SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_extract(url, '^https?://[^/?#]*') || '/root/dir/index.html?z' ELSE regexp_replace(url, '#.*$', '') END AS base,
         html || replace(replace('""" + _SQL_EXTRA + """', '{n}', CAST(page_id AS VARCHAR)), '{k}', CAST(page_id % 7 AS VARCHAR)) AS html FROM pages),
found AS (
  SELECT page_id, base, type, nr, """ + _ATTR.replace("NAME", "href") + """ AS raw FROM (""" + _TAGS.format("anchor", "a") + """)
  UNION ALL SELECT page_id, base, type, nr, """ + _ATTR.replace("NAME", "src") + """ FROM (""" + _TAGS.format("image", "img") + """)
  UNION ALL SELECT page_id, base, type, nr, """ + _ATTR.replace("NAME", "src") + """ FROM (""" + _TAGS.format("script", "script") + """)
  UNION ALL SELECT page_id, base, type, nr, """ + _ATTR.replace("NAME", "href") + """ FROM (""" + _TAGS.format("stylesheet", "link") + """)
            WHERE regexp_matches(t, '(?i)rel\\s*=\\s*["'']?[^"''>]*stylesheet')),
refs AS (
  SELECT page_id, base, type, nr, replace(raw, '&amp;', '&') AS raw, regexp_replace(replace(raw, '&amp;', '&'), '#.*$', '') AS ref
  FROM found WHERE raw <> '' AND raw NOT LIKE '#%' AND raw NOT LIKE 'mailto:%'),
cut AS (
  SELECT *, regexp_extract(base, '^https?:') AS scheme, regexp_extract(base, '^https?://[^/?#]*') AS site,
         regexp_extract(base, '^https?://[^/?#]*([^?]*)', 1) AS folder,
         regexp_extract(ref, '^[^?]*') AS rp, regexp_extract(ref, '\\?.*$') AS rq FROM refs),
joined AS (
  SELECT page_id, type, nr, raw, rq,
         CASE WHEN regexp_matches(rp, '(?i)^https?://') THEN regexp_replace(lower(regexp_extract(rp, '(?i)^https?://[^/]*')), ':80$', '')
              WHEN rp LIKE '//%' THEN scheme || regexp_extract(rp, '^//[^/]*') ELSE lower(site) END AS origin,
         CASE WHEN regexp_matches(rp, '(?i)^https?://') THEN regexp_replace(rp, '(?i)^https?://[^/]*', '')
              WHEN rp LIKE '//%' THEN regexp_replace(rp, '^//[^/]*', '') WHEN rp LIKE '/%' THEN rp WHEN rp = '' THEN folder
              ELSE regexp_extract(folder, '^(.*/)?') || rp END AS path FROM cut),
walked AS (
  SELECT *, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: replace(lower(s), '%2e', '.')) AS dots,
         string_split(regexp_replace(path, '^/', ''), '/') AS segments FROM joined),
kept AS (
  SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(segments, lambda s: [s])), lambda done, s:
    CASE WHEN replace(lower(s[1]), '%2e', '.') = '..' THEN done[1:len(done) - 1] WHEN replace(lower(s[1]), '%2e', '.') = '.' THEN done ELSE done || s END) AS done FROM walked),
urls AS (
  SELECT page_id, type, nr, raw, origin || list_aggregate(list_transform(regexp_extract_all(
    '/' || array_to_string(CASE WHEN dots[-1] IN ('.', '..') THEN list_append(done, '') ELSE done END, '/') || rq, '[!-~]+|[^!-~]+'),
    lambda s: CASE WHEN regexp_matches(s, '^[!-~]') THEN s ELSE url_encode(s) END), 'string_agg', '') AS url FROM kept)
SELECT page_id, type, url, arg_min(raw, nr) AS raw FROM urls GROUP BY ALL""")
def typed_links(spark: SparkSession, d: str) -> DataFrame:
    return links.typed_links(linked_pages(spark, d), "page_id")


# The lines of a supplier, in order, as block markup: openers, closers and whole blocks by quantity, so that some don't fit together.
BLOCK_LINES = """<!-- wp:image {{"id":{0}}} /-->|<!-- wp:group {{"w":{0}}} -->|<!-- wp:my/columns -->|<!-- /wp:group -->|<!-- /wp:my/columns -->|<!-- wp:group {{w:{0}}} -->|<!-- /wp:group -->"""
BLOCK_SQL = """
WITH RECURSIVE texts AS (
  SELECT l_suppkey AS doc, string_agg(CASE CAST(l_quantity AS INT) % 7 """ + " ".join(
      f"WHEN {k} THEN " + "'" + line.format("' || l_partkey || '") + "'" for k, line in enumerate(BLOCK_LINES.split("|"))) + """ END,
    ' <p>text</p> ' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS markup FROM lineitem GROUP BY 1),
found AS (
  SELECT doc, unnest(regexp_extract_all(markup, '<!-- [^>]* /?-->')) AS t, generate_subscripts(regexp_extract_all(markup, '<!-- [^>]* /?-->'), 1) AS nr FROM texts),
tokens AS (
  SELECT doc, nr, CASE WHEN t LIKE '<!-- /%' THEN -1 WHEN t LIKE '%/-->' THEN 0 ELSE 1 END AS step, regexp_matches(t, '[{]w:') AS bad,
         CASE WHEN t LIKE '%my/%' THEN 'my/columns' ELSE 'core/' || regexp_extract(t, 'wp:([a-z]+)', 1) END AS name FROM found),
walk AS (
  SELECT DISTINCT doc, 0::BIGINT AS nr, []::STRUCT(name VARCHAR, nr BIGINT)[] AS stack, []::STRUCT(name VARCHAR, nr BIGINT)[] AS around, 9 AS step,
         NULL::VARCHAR AS name, FALSE AS bad FROM texts
  UNION ALL
  SELECT t.doc, t.nr, CASE WHEN t.step = 1 THEN list_append(w.stack, {'name': t.name, 'nr': t.nr})
                           WHEN t.step = -1 THEN w.stack[1:len(w.stack) - 1] ELSE w.stack END, w.stack, t.step, t.name, t.bad
  FROM walk w JOIN tokens t ON t.doc = w.doc AND t.nr = w.nr + 1)"""


def marked_up(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_quantity").cast("int") % 7
    line = F.coalesce(*[F.when(kind == k, F.concat(*[x for part in line.format("\0").split("\0") for x in (F.lit(part), F.col("l_partkey").cast("string"))][:-1]))
                        for k, line in enumerate(BLOCK_LINES.split("|"))])
    lines = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", line.alias("line"))))
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return dealt(rows, tasks(rows, rows.count()), "l_suppkey").groupBy(F.col("l_suppkey").alias("doc")).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), " <p>text</p> ").alias("markup"))


@query("block_census", BLOCK_SQL + """
SELECT name, CAST(len(around) AS INT) AS depth, around[-1].name AS parent, count(*) AS n FROM walk WHERE step IN (0, 1) GROUP BY ALL""")
def block_census(spark: SparkSession, d: str) -> DataFrame:
    return blocks.census(blocks.blocks(marked_up(spark, d), "doc"))


@query("block_errors", BLOCK_SQL + """
SELECT doc, nr - 1 AS "at", 'unbalanced_closer' AS rule, name, NULL AS opened FROM walk WHERE step = -1 AND len(around) = 0
UNION ALL SELECT doc, nr - 1, 'mismatched_closer', name, around[-1].name FROM walk WHERE step = -1 AND around[-1].name <> name
UNION ALL SELECT doc, nr - 1, 'invalid_attributes', name, NULL FROM walk WHERE bad AND step IN (0, 1)
UNION ALL SELECT doc, open_.nr - 1, 'unclosed_block', open_.name, NULL
  FROM (SELECT doc, unnest(arg_max(stack, nr)) AS open_ FROM walk GROUP BY doc)""")
def block_errors(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_errors(marked_up(spark, d), "doc")


# Inside the content of every page: headings, an image, links, a form that is stripped and some unclosed elements; every third page has no article.
CONTENT_EXTRA = """<h2 class="x">Part <i>{k}</i></h2><a href="../n/{n}">next</a><form><h3>Search</h3><a href="/find">find</a></form><img alt="An &amp; image" src="pic {k}.png"><li><h3>Open end <a href="?more">more</a>"""
CONTENT_META = """<head><meta name="description" content="About {n}"><link rel="canonical" href="/c/{n}">"""


def content_pages(spark: SparkSession, d: str) -> DataFrame:
    pid = F.col("page_id")
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), pid.cast("string")), F.lit("{k}"), (pid % 7).cast("string"))
    html = F.replace(F.replace("html", F.lit("</article>"), F.concat(filled(CONTENT_EXTRA), F.lit("</article>"))), F.lit("<head>"), filled(CONTENT_META))
    bare = F.replace(F.replace(html, F.lit("<article>"), F.lit('<div id="content"><div>')), F.lit("</article>"), F.lit("</div></div>"))
    return table(spark, d, "pages").select("page_id", "url", F.when(pid % 3 == 0, bare).otherwise(html).alias("html"))


def _decoded(sql: str) -> str:
    """The replacements that character references take, as SQL."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#039;", "''"), ("&apos;", "''"), ("&nbsp;", " ")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


_FILL = "replace(replace('{0}', '{{n}}', CAST(page_id AS VARCHAR)), '{{k}}', CAST(page_id % 7 AS VARCHAR))"


@query("main_content", """
WITH a AS (
  SELECT page_id, url, replace(replace(html, '</article>', """ + _FILL.format(CONTENT_EXTRA) + """ || '</article>'), '<head>', """ + _FILL.format(CONTENT_META) + """) AS html FROM pages),
p AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS site, regexp_extract(url, '^https?://[^/?#]*([^?#]*/)?', 0) AS folder,
         CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS path,
         html, CASE WHEN page_id % 3 = 0 THEN 'content' ELSE 'article' END AS selector,
         regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM a),
c AS (
  SELECT *, regexp_replace(regexp_replace(body, '(?s)<(nav|header|footer|aside)\\b.*?</(nav|header|footer|aside)>', '', 'g'), '(?s)<form>.*?</form>', '', 'g') AS content FROM p),
cut AS (
  SELECT *, regexp_extract_all(content, '(?s)<h[1-6][^>]*>.*?</h[1-6]>|<h3>Open.*$') AS hs, regexp_extract_all(content, '<a href="([^"]*)"', 1) AS hrefs,
         regexp_extract_all(content, '<img[^>]*>') AS imgs FROM c)
SELECT page_id, replace(trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&nbsp;', ' ') AS title,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>|&nbsp;', ' ', 'g'), '\\s+', ' ', 'g')) AS h1,
  'About ' || page_id AS description, '/c/' || page_id AS canonical, selector,
  array_to_string(list_transform(hs, lambda h: regexp_extract(h, '<(h[1-6])', 1) || ':' || """ + _decoded(r"trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))") + """), '|') AS headings,
  array_to_string(list_transform(imgs, lambda i: folder || CASE WHEN folder = site THEN '/' ELSE '' END || replace(regexp_extract(i, 'src="([^"]*)"', 1), ' ', '%20') || ' ' || regexp_extract(i, 'alt="([^"]*)"', 1)), '|') AS images,
  array_to_string(list_transform(hrefs, lambda h: CASE WHEN h LIKE '../%' THEN site || coalesce(nullif(regexp_extract(regexp_replace(path, '[^/]*$', ''), '^(.*/)[^/]+/$', 1), ''), '/') || substring(h, 4)
    WHEN h LIKE '?%' THEN site || path || h ELSE h END), '|') AS links,
  """ + _decoded(
      r"trim(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))") + """ AS text
FROM cut""")
def main_content(spark: SparkSession, d: str) -> DataFrame:
    found = dom.main_content(content_pages(spark, d), "page_id")
    return found.select(
        "page_id", "title", "h1", "description", "canonical", "selector",
        F.array_join(F.transform("headings", lambda h: F.concat_ws(":", h["tag"], h["text"])), "|").alias("headings"),
        F.array_join(F.transform("images", lambda i: F.concat_ws(" ", i["src"], i["alt"])), "|").alias("images"),
        F.array_join("links", "|").alias("links"), "text")


def post_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every page as an exported post: JSON around its HTML, a block comment with JSON and HTML inside it, and serialized metadata."""
    page = F.col("page_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    content = text(
        F.coalesce("html", F.lit("")), '<img src="/wp-content/uploads/p/', page, '.jpg?w=9" srcset="a-', page, '.png 1x, https://cdn.test/wp-content/uploads/b-', page,
        '-300x200.png 2x"><div style="background:url(\'/bg/', page, '.webp\')"></div><!-- wp:image {"id":', page, ',"url":"https://cdn.test/wp-content/uploads/w-', page,
        '.gif?x=1","deep":[{"html":"<img src=\\"n-', page, '.svg\\">"}]} -->')
    name = text("füß-", page, ".jpg")
    meta = text('a:2:{s:4:"file";s:', F.octet_length(name).cast("string"), ':"', name, '";s:4:"note";s:26:"s:4:"file";s:8:"fake.jpg";";}')
    post = F.to_json(F.struct(F.struct(content.alias("content"), F.array(text("files/", page, ".pdf"), F.lit("no media")).alias("list"), meta.alias("meta")).alias("post")))
    return table(spark, d, "pages").select(F.col("page_id").alias("source"), text("2024/", (F.col("page_id") % 12).cast("string"), "/orig.jpg").alias("path"), post.alias("text"))


_MEDIA = r"\.(jpg|jpeg|png|gif|webp|heic|pdf|mp3|mp4|mov|wav|ogg|zip|svg|avif)$"


@query("media_references", rf"""
WITH p AS (SELECT page_id AS source, CAST(page_id AS VARCHAR) AS k, coalesce(html, '') AS html FROM pages),
named AS (SELECT source, 'post.content' AS place, 'attribute' AS context, unnest(regexp_extract_all(html, '(?i)(?:src|href)=[''"]([^''"]+)[''"]', 1)) AS raw FROM p
  UNION ALL SELECT source, 'post.content', 'srcset', regexp_extract(unnest(string_split(array_to_string(regexp_extract_all(html, '(?i)srcset=[''"]([^''"]+)[''"]', 1), ','), ',')), '^\s*(\S+)', 1) FROM p
  UNION ALL SELECT source, 'post.content', 'style', unnest(regexp_extract_all(html, '(?i)url\([''"]?([^''")]+)[''"]?\)', 1)) FROM p
  UNION ALL SELECT source, 'post.content', 'attribute', '/wp-content/uploads/p/' || k || '.jpg?w=9' FROM p
  UNION ALL SELECT source, 'post.content', 'srcset', 'a-' || k || '.png' FROM p
  UNION ALL SELECT source, 'post.content', 'srcset', 'https://cdn.test/wp-content/uploads/b-' || k || '-300x200.png' FROM p
  UNION ALL SELECT source, 'post.content', 'style', '/bg/' || k || '.webp' FROM p
  UNION ALL SELECT source, 'post.content.block[0].url', 'text', 'https://cdn.test/wp-content/uploads/w-' || k || '.gif?x=1' FROM p
  UNION ALL SELECT source, 'post.content.block[0].deep[0].html', 'attribute', 'n-' || k || '.svg' FROM p
  UNION ALL SELECT source, 'post.list[0]', 'text', 'files/' || k || '.pdf' FROM p)
SELECT source, place, context, raw, ltrim(regexp_extract(regexp_replace(regexp_replace(url_decode(trim(raw)), '^.*?wp-content/uploads/', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*', ''), '^[^?#]*'), '/') AS path
FROM named WHERE regexp_matches(lower(regexp_extract(raw, '^[^?#]*')), '{_MEDIA}')
UNION ALL SELECT source, 'post.meta', 'thumbnail', 'füß-' || k || '.jpg', '2024/' || source % 12 || '/füß-' || k || '.jpg' FROM p""")
def media_references(spark: SparkSession, d: str) -> DataFrame:
    return media.media_references(post_payloads(spark, d))
