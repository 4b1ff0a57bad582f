"""Probe, capture, schedule, structured-data and tile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions import html as H
from fleetlens.operators import nested
from fleetlens.plans import probes as P, schedule
from fleetlens.queries.registry import query, table



def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def responses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("page_id")
    p = table(spark, d, "pages")
    checks = p.select(
        F.concat(F.lit("/p/"), k).alias("path"), F.when(k % 7 == 0, 301).alias("expect_status"), F.when(k % 3 == 0, "<article>").when(k % 3 == 1, "no such text").otherwise("").alias("contains"),
        (k % 11 == 0).alias("json"), F.when(k % 7 == 0, F.concat(F.lit("/n/"), k)).alias("redirects_to"), F.when(k % 5 == 0, 1000).alias("max_ms"), _null("int").alias("min_bytes"))
    body = F.when(k % 17 == 0, F.lit(" tiny ")).when(k % 19 == 0, F.concat(F.lit("Uncaught TypeError"), "html")).otherwise(F.col("html"))
    answers = p.where(k % 23 != 0).select(
        F.concat(F.lit("/p/"), k).alias("path"), F.when(k % 7 == 0, 301).when(k % 13 == 0, 500).otherwise(200).alias("status"),
        F.when(k % 14 == 0, F.create_map(F.lit("LOCATION"), F.concat(F.lit("https://x.test/n/"), k, F.lit("/?q=1")))).when(
            k % 21 == 0, F.create_map(F.lit("location"), F.lit("/other"))).otherwise(_null("map<string,string>")).alias("headers"), body.alias("body"),
        (k * 37 % 3000).cast("double").alias("duration_ms"), (k % 29 == 0).alias("timed_out"), F.when(k % 31 == 0, "ECONNREFUSED").alias("error"))
    return checks, answers


RESP = """
c AS (SELECT page_id AS k, '/p/' || page_id AS path, html, page_id % 23 = 0 AS none, page_id % 29 = 0 AS tout, page_id % 31 = 0 AS err, page_id % 7 = 0 AS red, page_id * 37 % 3000 AS ms, page_id % 11 = 0 AS js FROM pages),
b AS (SELECT *, NOT none AND NOT tout AND NOT err AS ok, CASE WHEN k % 17 = 0 THEN ' tiny ' WHEN k % 19 = 0 THEN 'Uncaught TypeError' || html ELSE html END AS body FROM c),
hits AS (
  SELECT path, 'fail' AS severity, 'no_response' AS kind FROM b WHERE none UNION ALL SELECT path, 'fail', 'timed_out' FROM b WHERE NOT none AND tout
  UNION ALL SELECT path, 'fail', 'request_failed' FROM b WHERE NOT none AND NOT tout AND err UNION ALL SELECT path, 'fail', 'status' FROM b WHERE ok AND NOT red AND k % 13 = 0
  UNION ALL SELECT path, 'fail', 'no_location' FROM b WHERE ok AND red AND k % 14 <> 0 AND k % 21 <> 0
  UNION ALL SELECT path, 'fail', 'redirect_target' FROM b WHERE ok AND red AND k % 14 <> 0 AND k % 21 = 0
  UNION ALL SELECT path, 'fail', 'json' FROM b WHERE ok AND js UNION ALL SELECT path, 'fail', 'contains' FROM b WHERE ok AND (k % 3 = 1 OR (k % 3 = 0 AND position('<article>' IN body) = 0))
  UNION ALL SELECT path, 'fail', 'fatal_marker' FROM b WHERE ok AND k % 17 <> 0 AND k % 19 = 0 UNION ALL SELECT path, 'fail', 'tiny_body' FROM b WHERE ok AND k % 17 = 0 AND NOT js AND NOT red
  UNION ALL SELECT path, 'fail', 'too_slow' FROM b WHERE ok AND k % 5 = 0 AND ms > 1000 UNION ALL SELECT path, 'warn', 'slow' FROM b WHERE ok AND k % 5 <> 0 AND ms > 2000)"""


@query("response_checks", f"WITH {RESP} SELECT * FROM hits")
def response_checks(spark: SparkSession, d: str) -> DataFrame:
    return P.response_checks(*responses(spark, d)).select("path", "severity", "kind")


@query("response_summary", f"""
WITH {RESP}, f AS (SELECT DISTINCT path FROM hits WHERE severity = 'fail')
SELECT count(*) AS total, count(*) - (SELECT count(*) FROM f) AS passed, (SELECT count(*) FROM f) AS failed, (SELECT count(*) FROM hits WHERE severity = 'warn') AS warnings FROM c""")
def response_summary(spark: SparkSession, d: str) -> DataFrame:
    checks, answers = responses(spark, d)
    return P.check_summary(checks, P.response_checks(checks, answers))


DAY = 86_400_000


@query("tls_issues", """
WITH c AS (SELECT c_custkey AS k, 'h' || c_custkey AS host, c_custkey % 13 = 0 AS err, c_custkey % 70 - 5 AS days FROM customer)
SELECT host, 'red' AS severity, 'tls_error' AS kind, 'refused' AS detail FROM c WHERE err
UNION ALL SELECT host, 'red', 'hostname_mismatch', '' FROM c WHERE NOT err AND k % 5 = 0
UNION ALL SELECT host, 'red', 'self_signed', '' FROM c WHERE NOT err AND k % 9 = 0
UNION ALL SELECT host, 'red', 'chain_invalid', '' FROM c WHERE NOT err AND k % 9 <> 0 AND k % 10 = 0
UNION ALL SELECT host, 'red', 'cert_expired', CAST(days AS VARCHAR) FROM c WHERE NOT err AND days <= 0
UNION ALL SELECT host, 'amber', 'cert_expiry', CASE WHEN days <= 1 THEN '1' WHEN days <= 7 THEN '7' WHEN days <= 14 THEN '14' ELSE '30' END FROM c WHERE NOT err AND days > 0 AND days <= 30
UNION ALL SELECT host, 'amber', 'weak_protocol', 'TLSv1.1' FROM c WHERE NOT err AND k % 12 = 0""")
def tls_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    host = F.concat(F.lit("h"), k)
    return P.tls_issues(table(spark, d, "customer").select(
        F.concat(host, F.lit(".a.test")).alias("host"), F.lit(1_700_000_000_000).alias("now"), (F.lit(1_700_000_000_000 - 1000) + (k % 70 - 5) * DAY).alias("valid_to"),
        F.when(k % 5 == 0, F.array(F.lit("*.test"))).when(k % 5 == 1, F.array(F.lit("x.test"), F.lit("DNS:*.A.test"))).otherwise(F.array(F.concat(host, F.lit(".a.TEST")))).alias("names"),
        (k % 9 == 0).alias("self_signed"), (k % 10 != 0).alias("chain_valid"), F.when(k % 12 == 0, "TLSv1.1").otherwise("TLSv1.3").alias("protocol"),
        F.when(k % 13 == 0, "refused").alias("error"))).withColumn("host", F.regexp_replace("host", r"\.a\.test$", ""))


@query("domain_issues", """
WITH c AS (SELECT 'h' || c_custkey AS host, c_custkey % 90 - 5 AS days, c_custkey % 13 = 0 AS err, c_custkey % 17 = 0 AS nodate FROM customer)
SELECT host, 'amber' AS severity, 'rdap_error' AS kind FROM c WHERE err OR nodate UNION ALL SELECT host, 'red', 'domain_expired' FROM c WHERE NOT err AND NOT nodate AND days <= 0
UNION ALL SELECT host, 'amber', 'domain_expiry' FROM c WHERE NOT err AND NOT nodate AND days BETWEEN 1 AND 60""")
def domain_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return P.domain_issues(table(spark, d, "customer").select(
        F.concat(F.lit("h"), k).alias("host"), F.lit(0).alias("now"), F.when(k % 17 != 0, (k % 90 - 5) * DAY).alias("expiry"), F.when(k % 13 == 0, "timeout").alias("error"))).select("host", "severity", "kind")


@query("uptime_issues", """
WITH c AS (SELECT event_id AS k, 'e' || event_id AS host FROM events)
SELECT host, 'red' AS severity, 'down' AS kind FROM c WHERE k % 20 = 0 UNION ALL SELECT host, 'red', 'bad_status' FROM c WHERE k % 20 <> 0 AND k % 7 = 0
UNION ALL SELECT host, 'amber', 'http_only' FROM c WHERE k % 20 <> 0 AND k % 3 = 0 AND k % 2 = 0 UNION ALL SELECT host, 'info', 'https_redirect' FROM c WHERE k % 20 <> 0 AND k % 3 = 0 AND k % 2 = 1""")
def uptime_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return P.uptime_issues(table(spark, d, "events").select(
        F.concat(F.lit("e"), k).alias("host"), F.when(k % 3 == 0, "http://a").otherwise("https://a").alias("url"), F.when(k % 7 == 0, 503).otherwise(200).alias("status"),
        F.when(k % 2 == 1, "https://a").alias("final_url"), F.when(k % 20 == 0, "timeout").alias("error"))).select("host", "severity", "kind")


@query("dns_issues", """
WITH c AS (SELECT c_custkey AS k, 'h' || c_custkey AS host FROM customer)
SELECT host, 'red' AS severity, 'nxdomain' AS kind, '' AS detail FROM c WHERE k % 6 = 0 UNION ALL SELECT host, 'red', 'dns_error', '' FROM c WHERE k % 6 = 1
UNION ALL SELECT host, 'red', 'drift', 'A' FROM c WHERE k % 6 > 1 AND k % 5 = 0
UNION ALL SELECT host, 'info', 'propagation', 'r2' FROM c WHERE k % 6 = 2 OR (k % 6 > 2 AND k % 7 = 0)""")
def dns_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cust = table(spark, d, "customer")
    answers = cust.select(k, F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select(
        F.concat(F.lit("h"), k).alias("host"), "seq", F.concat(F.lit("r"), "seq").alias("resolver"), F.lit("A").alias("type"),
        F.when((k % 7 == 0) & (F.col("seq") == 2), F.array(F.lit("10.0.0.9"))).otherwise(F.array(F.lit("10.0.0.1"), F.lit("Alias.X"))).alias("records"),
        ((k % 6 == 0) | ((k % 6 == 2) & (F.col("seq") == 2))).alias("nxdomain"), F.when(k % 6 == 1, "SERVFAIL").alias("error"))
    expected = cust.where(k % 5 < 3).select(F.concat(F.lit("h"), k).alias("host"), F.lit("A").alias("type"), F.when(k % 5 == 0, "192.168").otherwise("10.0").alias("value"))
    return P.dns_issues(answers, expected)


@query("request_issues", """
SELECT 'pg' || user_id AS page, CASE WHEN event_id % 4 = 0 THEN 'info' WHEN event_id % 4 = 1 THEN 'warn' ELSE 'error' END AS severity,
  CASE WHEN event_id % 4 = 0 THEN 'beacon' WHEN event_id % 4 = 1 THEN 'aborted' ELSE 'failed_request' END AS kind, 'https://' || CASE WHEN event_id % 4 = 0 THEN 'stats.hotjar.io/x' ELSE 'a.test/' || event_id END AS detail
FROM events""")
def request_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return P.request_issues(table(spark, d, "events").select(
        F.concat(F.lit("pg"), "user_id").alias("page"), F.concat(F.lit("https://"), F.when(k % 4 == 0, F.concat(F.lit("stats.hotjar.io/x?"), k)).otherwise(F.concat(F.lit("a.test/"), k))).alias("url"),
        F.when(k % 4 == 1, "net::ERR_ABORTED").otherwise("net::ERR_TIMED_OUT").alias("reason")))


@query("console_issues", """
SELECT 'pg' || user_id AS page, CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END AS severity, CASE event_type WHEN 'error' THEN 'console_error' ELSE 'console_warning' END AS kind, props AS detail
FROM events WHERE event_type IN ('error', 'view')""")
def console_issues(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "view", "warning").otherwise("log")
    return P.console_issues(table(spark, d, "events").select(F.concat(F.lit("pg"), "user_id").alias("page"), kind.alias("type"), F.col("props").alias("text")))


@query("viewport_issues", """
WITH v AS (SELECT p_partkey AS k, 'p' || p_partkey AS page, CASE WHEN p_partkey % 2 = 0 THEN 360 ELSE 1280 END AS width FROM part)
SELECT page, width, 'error' AS severity, 'horizontal_scroll' AS kind, '400' AS detail FROM v WHERE width = 360 AND k % 3 = 0
UNION ALL SELECT page, width, 'error', 'nav_not_collapsed', '' FROM v WHERE width = 360 AND k % 5 = 0
UNION ALL SELECT page, width, 'warn', 'tap_overlap', 'a / target' FROM v WHERE k % 10 >= 2""")
def viewport_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    box = lambda label, x: F.struct(label.alias("label"), x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"))
    return P.viewport_issues(table(spark, d, "part").select(
        F.concat(F.lit("p"), k).alias("page"), F.when(k % 2 == 0, 360).otherwise(1280).alias("width"), _null("int").alias("viewport_width"),
        F.when(k % 3 == 0, 400).otherwise(361).alias("scroll_width"), F.when(k % 5 == 0, False).alias("nav_collapsed"),
        F.array(box(F.lit("a"), F.lit(0)), box(_null(), F.lit(20) - k % 10), box(F.lit("far"), F.lit(500))).alias("targets")))


@query("structure_issues", """
WITH s AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS h1, regexp_matches(html, '(?i)<footer\\b') AS foot FROM pages),
t AS (SELECT h1 FROM s WHERE page_id = 0)
SELECT page_id AS page, 'warn' AS severity, 'missing_heading' AS kind, 'h1:' || t.h1 AS detail FROM s, t WHERE s.h1 <> t.h1
UNION ALL SELECT page_id, 'info', 'extra_heading', 'h1:' || s.h1 FROM s, t WHERE s.h1 <> t.h1 AND s.h1 <> ''
UNION ALL SELECT page_id, 'error', 'missing_landmark', 'header' FROM s
UNION ALL SELECT page_id, 'error', 'missing_landmark', 'footer' FROM s WHERE NOT foot
UNION ALL SELECT page_id, 'warn', 'h1_count', '0' FROM s WHERE h1 = ''
UNION ALL SELECT page_id, 'warn', 'missing_block', 'image' FROM s""")
def structure_issues(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    facts = table(spark, d, "pages").select(F.col("page_id").alias("page"), F.lit("t").alias("template"), H.landmarks(h).alias("landmarks"), H.outline(h).alias("outline"), H.block_types(h).alias("blocks"))
    first = facts.where("page = 0").select("template", F.array(F.lit("nav"), F.lit("header"), F.lit("footer")).alias("landmarks"), "outline", F.array(F.lit("image")).alias("blocks"))
    return P.structure_issues(facts, first)


@query("hygiene_issues", """
WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS site, s_suppkey % 8 = 0 AS off FROM supplier)
SELECT site, 'info' AS severity, 'skipped' AS kind, '' AS detail FROM s WHERE off UNION ALL SELECT site, 'error', 'theme', 'other' FROM s WHERE NOT off AND k % 3 = 0
UNION ALL SELECT site, 'error', 'debug_output', '' FROM s WHERE NOT off AND k % 5 = 0 UNION ALL SELECT site, 'warn', 'sitemap', '404' FROM s WHERE NOT off AND k % 7 = 0
UNION ALL SELECT site, 'error', 'plugin_missing', 'seo' FROM s WHERE NOT off AND k % 4 = 1 UNION ALL SELECT site, 'warn', 'plugin_old', 'seo' FROM s WHERE NOT off AND k % 4 IN (2, 3)""")
def hygiene_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    sup = table(spark, d, "supplier")
    site = F.concat(F.lit("s"), k).alias("site")
    sites = sup.select(site, F.lit("t").alias("template"), (k % 8 != 0).alias("rest_available"), F.when(k % 3 == 0, "other").otherwise("main").alias("theme"), F.lit("main").alias("template_theme"),
                       (k % 5 == 0).alias("debug_output"), F.when(k % 7 == 0, 404).otherwise(200).alias("sitemap_status"), F.lit(200).alias("robots_status"))
    plugins = sup.where(k % 4 != 1).select(site, F.lit("seo").alias("name"), F.when(k % 4 == 2, "2.9-rc").otherwise("2.10.0").alias("version"), (k % 4 == 3).alias("update_available"))
    wanted = sup.select(F.lit("t").alias("template"), F.lit("seo").alias("name"), F.lit("2.10").alias("version"), F.lit(True).alias("active")).distinct()
    return P.hygiene_issues(sites, plugins, wanted)


@query("schedule_findings", """
WITH j AS (SELECT c_custkey AS k, 'crontab' || c_nationkey AS source, '/opt/job' || c_custkey % 700 || '.sh --token=[REDACTED]' AS item, c_custkey % 700 AS f, c_custkey % 3 = 0 AS timer FROM customer)
SELECT 'Unusual Frequency' AS category, 'Warning' AS severity, source, item FROM j WHERE (NOT timer AND k % 10 = 1) OR (timer AND k % 12 = 0)
UNION ALL SELECT 'Mismatched State', 'Critical', source, item FROM j WHERE timer AND k % 5 = 0
UNION ALL SELECT 'Missing Script', 'High', source, item FROM j WHERE f NOT IN (SELECT p_partkey % 700 FROM part WHERE p_partkey % 700 % 4 <> 0)
UNION ALL SELECT 'Unsafe Executable Permissions', 'Critical', source, item FROM j WHERE f % 4 = 1 UNION ALL SELECT 'Unsafe Executable Permissions', 'Warning', source, item FROM j WHERE f % 4 = 2
UNION ALL SELECT 'Conflicting Schedule / Overlap', 'Warning', 'Multiple', sch FROM (SELECT CASE WHEN timer THEN CASE WHEN k % 12 = 0 THEN '*:*:00' ELSE '0 0 * * *' END WHEN k % 10 = 1 THEN '*/1 * * * *' ELSE k || ' 1 * * *' END AS sch FROM j) GROUP BY sch HAVING count(*) > 1""")
def schedule_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    timer = k % 3 == 0
    items = table(spark, d, "customer").select(
        F.concat(F.lit("crontab"), "c_nationkey").alias("source"), F.when(timer, "systemd").otherwise("cron").alias("type"),
        F.when(timer, F.when(k % 12 == 0, "*:*:00").otherwise("daily")).when(k % 10 == 1, "*/1 * * * *").otherwise(F.concat(k, F.lit(" 1 * * *"))).alias("schedule"),
        F.concat(F.lit("/opt/job"), k % 700, F.lit(".sh --token=s3cr3t")).alias("command_or_unit"), timer.alias("on_calendar"),
        F.when(timer, "x.timer").alias("timer_file"), F.when(timer & (k % 5 != 0), "x.service").alias("service_file"))
    n = F.col("p_partkey") % 700
    files = table(spark, d, "part").where(n % 4 != 0).select(
        F.concat(F.lit("/opt/job"), n, F.lit(".sh")).alias("path"), F.when(n % 4 == 1, 0o777).when(n % 4 == 2, 0o775).otherwise(0o755).alias("mode")).distinct()
    return schedule.findings(items, files)


def json_ld_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Per document one graph of two nodes, one with a nested author, and for some a broken second block."""
    k = F.col("doc_id").cast("string")
    block = F.concat(
        F.lit('{"@context": "https://schema.org", "@graph": [{"@id": "d'), k, F.lit('", "@type": ["Article", "Post"], "author": {"@type": "Person", "name": "'), F.col("source"),
        F.lit('"}}, {"@id": "d'), F.when(F.col("doc_id") % 3 == 0, k).otherwise(F.concat(k, F.lit("x"))), F.lit('", "url": "https://old.test/'), k, F.lit('"}]}'))
    return table(spark, d, "documents").select(
        F.concat(F.lit("p"), k).alias("page"), F.array(block, F.when(F.col("doc_id") % 5 == 0, "{broken").otherwise("")).alias("blocks"))


@query("jsonld_flatten", """
WITH d AS (SELECT doc_id AS k, 'p' || doc_id AS page FROM documents)
SELECT page, 0 AS node_index, 'd' || k AS id, 'Article,Post' AS type, NULL AS parent_id, '' AS findings FROM d
UNION ALL SELECT page, 1, '_:b_1', 'Person', 'd' || k, '' FROM d
UNION ALL SELECT page, 2, CASE WHEN k % 3 = 0 THEN 'd' || k ELSE 'd' || k || 'x' END, NULL, NULL, CASE WHEN k % 3 = 0 THEN 'duplicate_id,missing_type,old_domain_reference' ELSE 'missing_type,old_domain_reference' END FROM d""")
def jsonld_flatten(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.json_ld_nodes(json_ld_blocks(spark, d), ("OLD.test",)).where("error is null")
    return nodes.select("page", "node_index", "id", F.array_join("type", ",").alias("type"), "parent_id", F.array_join("findings", ",").alias("findings"))


@query("jsonld_totals", """
SELECT count(*) AS pages, 3 * count(*) AS nodes, count(*) FILTER (doc_id % 5 = 0) AS errors, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS findings FROM documents""")
def jsonld_totals(spark: SparkSession, d: str) -> DataFrame:
    return nested.extraction_totals(nested.json_ld_nodes(json_ld_blocks(spark, d), ("old.test",)))


@query("json_string_paths", """
SELECT path, count(*) AS n FROM (SELECT unnest(['conv[0].role', 'conv[0].text']) AS path FROM conversations) GROUP BY 1""")
def json_string_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("source"), F.to_json(F.struct(F.array(F.struct("role", "text", "turn")).alias("conv"))).alias("text"))
    return nested.json_strings(docs).groupBy("path").agg(F.count("*").alias("n"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    """One layer per order, a cell per line item: its part is the tile, some flipped or empty."""
    flip = F.when(F.col("l_suppkey") % 3 == 0, 2 ** 31).otherwise(0)
    gid = F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_partkey") + flip)
    cells = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", gid.alias("g")))).alias("c"))
    n = F.size("c")
    return cells.select(
        F.concat(F.lit("m"), F.col("l_orderkey") % 50).alias("map"), F.concat(F.lit("L"), "l_orderkey").alias("layer"), F.lit(2).alias("width"), F.floor((n + 1) / 2).cast("int").alias("height"),
        F.lit(2).alias("map_width"), F.lit(2).alias("map_height"), F.transform("c", lambda x: x["g"]).alias("data"), F.lit(0).alias("x0"), F.lit(0).alias("y0"))


@query("tile_layer_issues", """
WITH l AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'm' || o % 50 AS map, 'L' || o AS layer, 'dimension' AS problem FROM l WHERE (n + 1) // 2 <> 2 UNION ALL SELECT 'm' || o % 50, 'L' || o, 'data_size' FROM l WHERE n % 2 = 1""")
def tile_layer_issues(spark: SparkSession, d: str) -> DataFrame:
    return nested.layer_issues(layers(spark, d))


@query("tile_invalid_gids", """
WITH c AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 2147483648 ELSE 0 END END) - 1 AS idx, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey END AS gid FROM lineitem)
SELECT 'm' || o % 50 AS map, 'L' || o AS layer, CAST(idx % 2 AS BIGINT) AS x, CAST(idx // 2 AS BIGINT) AS y, gid FROM c WHERE gid <> 0 AND gid % 40 >= 30""")
def tile_invalid_gids(spark: SparkSession, d: str) -> DataFrame:
    # A map has the tilesets that its parts fall in: 30 ids out of every 40.
    first = F.floor(F.col("l_partkey") / 40) * 40
    own = table(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_orderkey") % 50).alias("map"), first.alias("lo"), (first + 29).alias("hi")).distinct()
    cells = nested.invalid_gids(nested.tile_cells(layers(spark, d)), own)
    return cells.select("map", "layer", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "gid")


@query("tile_objects", """
WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS uid, l_orderkey % 50 AS m, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS id, l_returnflag AS type FROM lineitem),
r AS (SELECT m, id, min(uid) AS f FROM o WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT uid, 'duplicate_id' AS problem FROM o JOIN r USING (m, id) WHERE uid <> f
UNION ALL SELECT uid, 'missing_id' FROM o WHERE id IS NULL UNION ALL SELECT uid, 'object_type' FROM o WHERE type = 'N'""")
def tile_objects(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), (F.col("l_orderkey") % 50).alias("map"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("id"), F.col("l_returnflag").alias("type"))
    return nested.object_issues(objects, ["A", "R"])


@query("tile_properties", """
SELECT p_partkey AS id, p_type AS type, 'owner' AS property FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_type, 'weight' FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_partkey % 2 = 0""")
def tile_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    given = F.filter(F.array(
        F.struct(F.when(k % 3 != 0, "owner").alias("name"), F.lit("a").alias("value")), F.struct(F.lit("note").alias("name"), F.lit("b").alias("value")),
        F.struct(F.when(k % 2 != 0, "weight").alias("name"), F.lit("c").alias("value")), F.struct(F.lit("note").alias("name"), F.lit("d").alias("value"))), lambda p: p["name"].isNotNull())
    objects = part.select(k.alias("id"), F.col("p_type").alias("type"), nested.property_map(given).alias("properties"))
    required = part.agg(F.min("p_type").alias("type")).select("type", F.lit("weight").alias("property")).unionByName(
        part.agg(F.lit("*").alias("type"), F.lit("owner").alias("property")))
    return nested.missing_properties(objects, required)
