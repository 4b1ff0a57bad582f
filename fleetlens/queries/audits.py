"""Localization, secrets, package and media queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions import mask as M
from fleetlens.operators import findings as FD, media
from fleetlens.plans import localization, packages, secrets
from fleetlens.queries.registry import query, table


# --- localization: parts are strings, one locale per return flag -----------------------------

def canonical(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.concat(F.col("p_name"), F.when(k % 4 == 0, " {count} of %d").otherwise(""),
                                F.when(k % 5 == 0, " <b>bold</b>").otherwise(""), F.when(k % 6 == 0, "\n").otherwise("")).alias("text"))


def catalogs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    base = canonical(spark, d)
    text = (F.when(k % 7 == 0, F.replace("text", F.lit("{count}"), F.lit("{cnt}"))).when(k % 7 == 1, F.replace("text", F.lit("</b>"), F.lit("")))
            .when(k % 7 == 2, F.replace("text", F.lit("\n"), F.lit("\\n"))).when(k % 7 == 3, F.col("text"))
            .when(k % 7 == 4, F.concat("text", F.lit(" "), F.reverse("text"), F.lit(" "), "text")).otherwise(F.concat(F.lit("x"), "text")))
    de = base.where(k % 11 != 0).select(F.lit("de").alias("locale"), "id", text.alias("text"))
    fr = base.select(F.lit("fr").alias("locale"), (k + F.when(k % 13 == 0, 10_000_000).otherwise(0)).alias("id"), F.upper("text").alias("text"))
    return de.unionByName(fr)


CATALOG = """
c AS (SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' {count} of %d' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' <b>bold</b>' ELSE '' END ||
        CASE WHEN p_partkey % 6 = 0 THEN chr(10) ELSE '' END AS text FROM part),
l AS (SELECT 'de' AS locale, id, CASE id % 7 WHEN 0 THEN replace(text, '{count}', '{cnt}') WHEN 1 THEN replace(text, '</b>', '') WHEN 2 THEN replace(text, chr(10), '\\n')
        WHEN 3 THEN text WHEN 4 THEN text || ' ' || reverse(text) || ' ' || text ELSE 'x' || text END AS text FROM c WHERE id % 11 <> 0
      UNION ALL SELECT 'fr', id + CASE WHEN id % 13 = 0 THEN 10000000 ELSE 0 END, upper(text) FROM c),
j AS (SELECT coalesce(w.locale, l.locale) AS locale, coalesce(w.id, l.id) AS id, w.text AS c, l.text AS l FROM
       (SELECT c.*, x.locale FROM c, (SELECT unnest(['de', 'fr']) AS locale) x) w FULL JOIN l ON w.locale = l.locale AND w.id = l.id),
f AS (SELECT *, list_sort(list_concat(regexp_extract_all(c, '\\{[a-zA-Z_0-9]+\\}'), regexp_extract_all(c, '%[dsf]'))) AS pc,
        list_sort(list_concat(regexp_extract_all(l, '\\{[a-zA-Z_0-9]+\\}'), regexp_extract_all(l, '%[dsf]'))) AS pl,
        list_sort(regexp_extract_all(c, '</?([a-zA-Z0-9_\\-]+)(?:\\s+[^>]*?)?>', 1)) AS tc, list_sort(regexp_extract_all(l, '</?([a-zA-Z0-9_\\-]+)(?:\\s+[^>]*?)?>', 1)) AS tl FROM j),
found AS (
  SELECT locale, id, 'missing_key' AS rule FROM f WHERE l IS NULL UNION ALL SELECT locale, id, 'extra_key' FROM f WHERE c IS NULL
  UNION ALL SELECT locale, id, 'placeholder_drift' FROM f WHERE c IS NOT NULL AND l IS NOT NULL AND pc <> pl AND locale <> 'fr'
  UNION ALL SELECT locale, id, 'tag_imbalance' FROM f WHERE c IS NOT NULL AND l IS NOT NULL AND (tc <> tl OR (l LIKE '%<b>%' AND l NOT LIKE '%</b>%') OR l LIKE '%>b<%')
  UNION ALL SELECT locale, id, 'line_break_drift' FROM f WHERE length(c) - length(replace(c, chr(10), '')) <> length(l) - length(replace(l, chr(10), '')) OR (l LIKE '%\\n%')
  UNION ALL SELECT locale, id, 'untranslated' FROM f WHERE c = l AND length(trim(l)) >= 5 AND NOT regexp_matches(trim(l), '^\\d+$')
  UNION ALL SELECT locale, id, 'text_expansion' FROM f WHERE length(l) > floor(length(c) * CASE WHEN length(c) <= 15 THEN 2.5::DOUBLE WHEN length(c) <= 50 THEN 1.8::DOUBLE ELSE 1.4::DOUBLE END))
"""


@query("catalog_qa", f"WITH {CATALOG} SELECT locale, CAST(id AS VARCHAR) AS id, rule FROM found WHERE id <> 42")
def catalog_qa(spark: SparkSession, d: str) -> DataFrame:
    config = localization.Config(ignores=(localization.Ignore(ids=("42",)), localization.Ignore(checks=("placeholder_drift",), locale="fr")))
    found = localization.findings(canonical(spark, d).withColumn("id", F.col("id").cast("string")),
                                  catalogs(spark, d).withColumn("id", F.col("id").cast("string")), config)
    return found.select(F.col("location").alias("locale"), F.col("entity_id").alias("id"), "rule")


@query("catalog_duplicates", """
SELECT p_brand AS locale, p_size AS id, count(*) AS n FROM part GROUP BY 1, 2 HAVING n > 1""")
def catalog_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return localization.duplicate_ids(table(spark, d, "part").select(F.col("p_brand").alias("locale"), F.col("p_size").alias("id")))


# --- secrets ------------------------------------------------------------------------------

def scanned(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, with a credential line derived from the id and, for some, binary or example names."""
    k = F.col("doc_id")
    h = F.sha2(k.cast("string"), 256)
    key = F.when(k % 8 == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))).when(
        k % 8 == 1, F.concat(F.lit("api_key = \""), h, F.lit("\""))).when(
        k % 8 == 2, F.concat(F.lit("postgres://app:"), F.substring(h, 1, 12), F.lit("@db/main"))).when(
        k % 8 == 3, F.lit("token: your_token_goes_here_please_change")).otherwise("")
    return table(spark, d, "documents").select(
        F.concat(F.lit("src/"), F.when(k % 50 == 0, "node_modules/").otherwise(""), k, F.when(k % 60 == 0, ".example").otherwise(".txt")).alias("file"),
        F.concat("text", F.lit("\n"), key).alias("text"))


SCAN = r"""
src AS (SELECT 'src/' || CASE WHEN doc_id % 50 = 0 THEN 'node_modules/' ELSE '' END || doc_id || CASE WHEN doc_id % 60 = 0 THEN '.example' ELSE '.txt' END AS file,
  text || chr(10) || CASE doc_id % 8 WHEN 0 THEN 'AKIA' || upper(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)) WHEN 1 THEN 'api_key = "' || sha256(CAST(doc_id AS VARCHAR)) || '"'
    WHEN 2 THEN 'postgres://app:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) || '@db/main' WHEN 3 THEN 'token: your_token_goes_here_please_change' ELSE '' END AS text FROM documents),
ok AS (SELECT file, string_split_regex(text, '\r?\n') AS ls FROM src WHERE file NOT LIKE 'src/node_modules/%' AND file NOT LIKE '%.example' AND position(chr(0) IN text) = 0),
lines AS (SELECT * FROM (SELECT file, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM ok)),
hit AS (
  SELECT file, line, 'aws' AS rule, unnest(regexp_extract_all(text, '\b((?:AKIA|ASIA|AGPA|AROA)[0-9A-Z]{16})\b', 1)) AS secret FROM lines
  UNION ALL SELECT file, line, 'gcp', unnest(regexp_extract_all(text, '\b(AIza[0-9A-Za-z_-]{35})\b', 1)) FROM lines
  UNION ALL SELECT file, line, 'stripe', unnest(regexp_extract_all(text, '\b((?:sk|rk)_live_[0-9a-zA-Z]{16,})\b', 1)) FROM lines
  UNION ALL SELECT file, line, 'github_pat', unnest(regexp_extract_all(text, '\b(gh[pousr]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{22,255})\b', 1)) FROM lines
  UNION ALL SELECT file, line, 'private_key', unnest(regexp_extract_all(text, '(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----)', 1)) FROM lines
  UNION ALL SELECT file, line, 'db_url', unnest(regexp_extract_all(text, '\b((?:mysql|mariadb|postgres(?:ql)?|mongodb(?:\+srv)?|redis|amqp)://[^\s''"@:/]+:([^\s''"@]{3,})@[^\s''"]+)', 2)) FROM lines
  UNION ALL SELECT file, line, 'wp_salts', unnest(regexp_extract_all(text, 'define\(\s*[''"]((?:AUTH|SECURE_AUTH|LOGGED_IN|NONCE)_(?:KEY|SALT))[''"]\s*,\s*[''"]([^''"]{16,})[''"]\s*\)', 2)) FROM lines
  UNION ALL SELECT * FROM (SELECT file, line, 'generic_high_entropy', unnest(regexp_extract_all(text, '(?i)(?:secret|token|passw(?:or)?d|api[_-]?key|access[_-]?key|auth[_-]?key|credential)[A-Za-z0-9_-]*["'']?\s*(?:[:=]|=>)\s*["'']?([A-Za-z0-9+/=_-]{20,})', 1)) AS secret FROM lines)
    WHERE list_entropy(string_split(secret, '')) >= 3.8 AND NOT regexp_matches(secret, '(?i)^(x+|\*+|\.+|your[_-]|changeme|example|placeholder|<.*>$)')),
scan AS (SELECT file, line, rule, sha256(secret) AS fingerprint, CASE WHEN length(secret) <= 8 THEN '****' WHEN length(secret) <= 14 THEN left(secret, 2) || '****' || right(secret, 2)
    ELSE left(secret, 3) || '****' || right(secret, 4) END AS masked_secret FROM hit)
"""


@query("secret_scan", f"WITH {SCAN} SELECT * FROM scan")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan_lines(secrets.file_lines(scanned(spark, d))).select("file", "line", "rule", "fingerprint", "masked_secret")


@query("secret_allowlist", f"""
WITH {SCAN}, s AS (SELECT * FROM scan WHERE fingerprint NOT IN (SELECT sha256(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12)) FROM documents WHERE doc_id % 16 = 2))
SELECT rule, count(*) AS n FROM s GROUP BY rule""")
def secret_allowlist(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan_lines(secrets.file_lines(scanned(spark, d)))
    literal = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12)
    allowed = table(spark, d, "documents").where("doc_id % 16 = 2").select(
        F.when(F.col("doc_id") % 32 == 2, F.concat(F.lit(" "), literal)).otherwise(F.upper(F.sha2(literal, 256))).alias("line"))
    return secrets.without_allowed(found, allowed).groupBy("rule").agg(F.count("*").alias("n"))


@query("secret_merge", f"""
WITH {SCAN}, every AS (SELECT file, rule, fingerprint, line, 'worktree' AS loc FROM scan WHERE line % 3 <> 0
  UNION ALL SELECT file, rule, fingerprint, line + 100, 'history' FROM scan WHERE line % 2 = 0)
SELECT file, rule, fingerprint, CASE WHEN count(DISTINCT loc) > 1 THEN 'both' ELSE min(loc) END AS location,
  coalesce(max(line) FILTER (loc = 'worktree'), min(line)) AS line FROM every GROUP BY 1, 2, 3""")
def secret_merge(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan_lines(secrets.file_lines(scanned(spark, d)))
    old = found.where("line % 2 = 0").withColumn("line", F.col("line") + 100).withColumn("location", F.lit("history")).withColumn("commit", F.lit("abc12345"))
    return secrets.merge_locations(found.where("line % 3 <> 0").unionByName(old)).select("file", "rule", "fingerprint", "location", "line")


ENVS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("env_drift", """
WITH v AS (SELECT c_mktsegment AS env, 'KEY_' || c_custkey % 400 AS key, c_custkey AS seq,
   CASE c_custkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '12.5' WHEN 2 THEN 'https://a.test/x' WHEN 3 THEN '' ELSE 'word' END AS value FROM customer),
s AS (SELECT env, key, arg_max(CASE value WHEN 'true' THEN 'bool' WHEN '12.5' THEN 'number' WHEN '' THEN 'empty' WHEN 'word' THEN 'string' ELSE 'url' END, seq) AS shape FROM v GROUP BY 1, 2),
k AS (SELECT key, list_sort(list(env)) AS present, array_to_string(list_sort(list(env || '=' || shape)), ',') AS shapes, count(DISTINCT shape) AS n FROM s GROUP BY 1)
SELECT key, 'missing_key' AS rule, array_to_string(list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda e: NOT list_contains(present, e)), ',') AS detail FROM k WHERE len(present) < 5
UNION ALL SELECT key, 'shape_mismatch', shapes FROM k WHERE n > 1""")
def env_drift(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    values = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("env"), F.concat(F.lit("KEY_"), k % 400).alias("key"), k.alias("seq"),
        F.when(k % 6 == 0, "true").when(k % 6 == 1, "12.5").when(k % 6 == 2, "https://a.test/x").when(k % 6 == 3, "").otherwise("word").alias("value"))
    return secrets.env_drift(values, ENVS)


@query("redact_text", r"""
SELECT doc_id, sha256(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@', '\1[REDACTED]@', 'g')) AS redacted FROM documents""")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(M.redact_userinfo(F.col("text")), 256).alias("redacted"))


@query("redact_map", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '[REDACTED]' ELSE regexp_extract(props, '"k": ([^}]*)', 1) END AS v FROM events""")
def redact_map(spark: SparkSession, d: str) -> DataFrame:
    props = F.map_values(F.from_json("props", "map<string,string>"))
    named = F.create_map(F.when(F.col("event_type") == "error", "api_token").otherwise("k"), F.get(props, 0))
    return table(spark, d, "events").select("event_id", F.get(F.map_values(M.redact_map(named)), 0).alias("v"))


@query("exposed_probes", """
SELECT url, CASE WHEN regexp_matches(html, '(?i)<(!doctype|html|head|body)\\b') THEN 'reachable_path' ELSE 'exposed_config' END AS rule,
  CASE WHEN regexp_matches(html, '(?i)<(!doctype|html|head|body)\\b') THEN 'low' ELSE 'high' END AS severity
FROM (SELECT url, CASE WHEN page_id % 4 = 0 THEN 'DB_HOST=local' || chr(10) || 'X=1' ELSE html END AS html FROM pages)""")
def exposed_probes(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("page_id") % 4 == 0, F.lit("DB_HOST=local\nX=1")).otherwise(F.col("html"))
    return secrets.exposed_probes(table(spark, d, "pages").select("url", F.lit(200).alias("status"), body.alias("body")))


@query("sensitive_files", """
SELECT path, rule FROM (
  SELECT 'd' || c_custkey % 300 || '/' || CASE c_custkey % 9 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN 'Tls.PEM' WHEN 3 THEN 'config.yml' WHEN 4 THEN 'a' || c_custkey || '.key' ELSE 'f' || c_custkey END AS path,
    CASE c_custkey % 9 WHEN 0 THEN 'environment_file' WHEN 2 THEN 'private_key' WHEN 4 THEN 'private_key' WHEN 3 THEN CASE WHEN c_custkey % 300 % 2 = 1 THEN 'config_with_example' END END AS rule FROM customer)
WHERE rule IS NOT NULL""")
def sensitive_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = (F.when(k % 9 == 0, ".env").when(k % 9 == 1, ".env.example").when(k % 9 == 2, "Tls.PEM").when(k % 9 == 3, "config.yml")
            .when(k % 9 == 4, F.concat(F.lit("a"), k, F.lit(".key"))).otherwise(F.concat(F.lit("f"), k)))
    cust = table(spark, d, "customer")
    files = cust.select(F.concat(F.lit("d"), k % 300, F.lit("/"), name).alias("path"))
    examples = cust.where(k % 300 % 2 == 1).select(F.concat(F.lit("d"), k % 300, F.lit("/config.example.yml")).alias("path")).distinct()
    return secrets.sensitive_files(files.unionByName(examples))


# --- packages -----------------------------------------------------------------------------

def installed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v = lambda a, b: F.concat(F.lit("v"), a, F.lit("."), b, F.lit(".3-beta"))
    return table(spark, d, "part").select(
        F.col("p_brand").alias("project"), F.lit("npm").alias("type"), F.concat(F.lit("pkg"), k).alias("package"), (k % 50).alias("grp"),
        F.when(k % 12 == 0, F.lit(None)).when(k % 12 == 1, "dev-main").otherwise(v(F.col("p_size") % 5, k % 10)).alias("current"),
        F.when(k % 15 == 0, F.lit(None)).otherwise(v(F.col("p_size") % 5 + F.when(k % 3 == 0, 1).otherwise(0), k % 10 + F.when(k % 4 == 0, 2).otherwise(-1) + 1)).alias("latest"), k.alias("k"))


JUMP = """
p AS (SELECT p_brand AS project, 'npm' AS type, 'pkg' || p_partkey AS package, p_partkey AS k, p_partkey % 12 = 0 AS nocur, p_partkey % 12 <= 1 AS badcur, p_partkey % 15 = 0 AS nolat,
   p_size % 5 AS ma, p_partkey % 10 AS mi, p_size % 5 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS la, p_partkey % 10 + CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 0 END AS li FROM part),
v AS (SELECT *, CASE WHEN k % 12 = 0 THEN NULL WHEN k % 12 = 1 THEN 'dev-main' ELSE 'v' || ma || '.' || mi || '.3-beta' END AS current, CASE WHEN nolat THEN NULL ELSE 'v' || la || '.' || li || '.3-beta' END AS latest,
   CASE WHEN badcur OR nolat THEN 'unknown' WHEN la > ma THEN 'major' WHEN li > mi THEN 'minor' ELSE 'none' END AS jump FROM p),
adv AS (SELECT 'pkg' || l_partkey AS package, l_suppkey % 4 = 0 AS open, l_linenumber AS b FROM lineitem),
vc AS (SELECT v.*, (SELECT count(*) FROM adv a WHERE a.package = v.package AND (a.open OR v.nocur OR (NOT v.badcur AND (v.ma < a.b OR (v.ma = a.b AND FALSE))))) AS advisories FROM v),
cl AS (SELECT *, advisories > 0 AS security, CASE WHEN advisories > 0 THEN 'security' WHEN jump = 'unknown' THEN 'minor' WHEN jump <> 'none' THEN jump END AS severity FROM vc)
"""


def advisories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("pkg"), "l_partkey").alias("package"),
        F.when(F.col("l_suppkey") % 4 != 0, F.concat("l_linenumber", F.lit(".0"))).alias("affected_below"))


@query("version_jump", f"WITH {JUMP} SELECT package, current, latest, jump FROM v")
def version_jump(spark: SparkSession, d: str) -> DataFrame:
    return packages.dependency_rows(installed(spark, d)).select("package", "current", "latest", "jump")


@query("advisory_join", f"WITH {JUMP} SELECT package, advisories FROM vc")
def advisory_join(spark: SparkSession, d: str) -> DataFrame:
    return packages.advisory_counts(installed(spark, d), advisories(spark, d)).select("package", "advisories")


def classified(spark: SparkSession, d: str) -> DataFrame:
    rows = packages.dependency_rows(packages.advisory_counts(installed(spark, d), advisories(spark, d)))
    return packages.classify(rows)


@query("dependency_digest", f"WITH {JUMP} SELECT project, package, severity, security FROM cl WHERE severity IS NOT NULL AND NOT (advisories = 0 AND nolat)")
def dependency_digest(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("project", "package", "severity", "security")


@query("dependency_new", f"""
WITH {JUMP}, c AS (SELECT * FROM cl WHERE severity IS NOT NULL AND NOT (advisories = 0 AND nolat))
SELECT package, severity FROM c WHERE k % 5 = 0 OR (k % 5 = 1) OR (k % 5 = 2 AND security)""")
def dependency_new(spark: SparkSession, d: str) -> DataFrame:
    now = classified(spark, d)
    earlier = now.where("k % 5 <> 0").select(
        "project", "type", "package", F.when(F.col("k") % 5 == 1, F.lit("v0")).otherwise(F.col("latest")).alias("latest"),
        (F.col("security") & (F.col("k") % 5 != 2)).alias("security"))
    return packages.new_since(now, earlier).select("package", "severity")


@query("dependency_per_project", f"""
WITH {JUMP}, c AS (SELECT * FROM cl WHERE severity IS NOT NULL AND NOT (advisories = 0 AND nolat) AND project <> 'Brand#1')
SELECT b.project, count(c.package) AS total, count(*) FILTER (severity = 'security') AS security, count(*) FILTER (severity = 'major') AS major,
  count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'patch') AS patch
FROM (SELECT DISTINCT p_brand AS project FROM part) b LEFT JOIN c ON b.project = c.project GROUP BY 1""")
def dependency_per_project(spark: SparkSession, d: str) -> DataFrame:
    rows = classified(spark, d).where("project <> 'Brand#1'")
    return packages.per_project(rows, table(spark, d, "part").select(F.col("p_brand").alias("project")))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("site"), F.when(k % 20 == 0, "core").when(k % 20 == 1, "mu-plugin").when(k % 5 == 2, "theme").otherwise("plugin").alias("ext_type"),
        F.concat(F.lit("ext"), k % 100).alias("name"), F.when(k % 6 == 0, "inactive").otherwise("active").alias("status"),
        F.when(k % 7 == 0, "available").otherwise("none").alias("update"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("6."), F.col("p_size") % 6, F.when(k % 2 == 0, ".0").otherwise(""))).alias("version"),
        F.when(k % 7 == 0, "6.4").alias("update_version"))


POLICY_SQL = """
i AS (SELECT p_brand AS site, CASE WHEN p_partkey % 20 = 0 THEN 'core' WHEN p_partkey % 20 = 1 THEN 'mu-plugin' WHEN p_partkey % 5 = 2 THEN 'theme' ELSE 'plugin' END AS kind,
  'ext' || p_partkey % 100 AS name, p_partkey % 100 AS n, p_partkey % 6 = 0 AS inactive, p_partkey % 7 = 0 AS upd, p_partkey % 9 = 0 AS nover, p_size % 6 AS mi FROM part),
pol AS (
  SELECT site, kind || ':' || name AS entity, 'core_outdated' AS rule, 'critical' AS severity FROM i WHERE kind = 'core' AND NOT nover AND mi < 2
  UNION ALL SELECT site, kind || ':' || name, 'unknown_version', 'low' FROM i WHERE kind <> 'core' AND nover
  UNION ALL SELECT site, kind || ':' || name, 'disallowed', 'critical' FROM i WHERE (kind IN ('plugin', 'mu-plugin') AND n IN (3, 41)) OR (kind = 'theme' AND n = 7)
  UNION ALL SELECT site, kind || ':' || name, 'not_allowed', 'high' FROM i WHERE kind = 'theme' AND n NOT IN (2, 7, 12)
  UNION ALL SELECT site, kind || ':' || name, 'inactive', 'medium' FROM i WHERE kind IN ('plugin', 'theme') AND inactive
  UNION ALL SELECT site, kind || ':' || name, 'update_available', 'high' FROM i WHERE (kind IN ('plugin', 'theme') AND upd) OR (kind = 'core' AND upd AND (nover OR mi < 4)))"""
POLICY = packages.Policy(min_core_version="6.2", disallowed_plugins=("ext3", "ext41"), disallowed_themes=("ext7",),
                         allowed_themes=("ext2", "ext7", "ext12"), severities={"unknown_version": "low"})


@query("policy_findings", f"WITH {POLICY_SQL} SELECT * FROM pol")
def policy_findings(spark: SparkSession, d: str) -> DataFrame:
    return packages.policy_findings(inventory(spark, d), POLICY).select(
        F.col("location").alias("site"), F.col("entity_id").alias("entity"), "rule", "severity")


@query("risk_rollup", f"""
WITH {POLICY_SQL}
SELECT site, entity, count(*) AS n_findings, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)
  WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS highest, array_to_string(list_sort(list(DISTINCT rule)), '; ') AS messages
FROM pol GROUP BY 1, 2""")
def risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    found = packages.policy_findings(inventory(spark, d), POLICY).select(
        F.col("location").alias("site"), F.col("entity_id").alias("entity"), F.col("rule").alias("message"), "severity")
    return FD.risk_rollup(found, ["site", "entity"], FD.SEVERITY_ORDER["policy"])


@query("inventory_counts", """
SELECT CASE WHEN p_partkey % 20 = 0 THEN 'core' WHEN p_partkey % 20 = 1 THEN 'mu-plugin' WHEN p_partkey % 5 = 2 THEN 'theme' ELSE 'plugin' END AS ext_type,
  count(*) AS total, count(*) FILTER (p_partkey % 6 <> 0) AS active, count(*) FILTER (p_partkey % 6 = 0) AS inactive, count(*) FILTER (p_partkey % 7 = 0) AS updates FROM part GROUP BY 1""")
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    return packages.inventory_counts(inventory(spark, d))


# --- nested records -----------------------------------------------------------------------

DEPTH = 50
#: Records that a task gets: they are made and cut there, and the file they come from may be one task's.
RECORDS = 10_000


@query("redact_nested", r"""
SELECT c_custkey AS id, repeat('{"n": [', 50) || '{"api_token": "[REDACTED]", "name": "' || c_name || '", "note": "see https://bob:[REDACTED]@h.test/' || c_custkey ||
  '", "Secret": {"count": ' || c_custkey || ', "pwd": "[REDACTED]"}, "list": ["\"token\": \"kept\"", {"auth": ["plain", 1]}, "[REDACTED] and [REDACTED]"], ' ||
  '"password": "[REDACTED]", "password": "[REDACTED]", "k\u0065y": "[REDACTED]", "note2": null}' || repeat(']}', 50) AS record FROM customer""")
def redact_nested(spark: SparkSession, d: str) -> DataFrame:
    """A record per customer, fifty levels deep, with arrays, repeated and escaped names, and quotes within strings."""
    k = F.col("c_custkey").cast("string")
    record = F.concat(
        F.lit('{"n": [' * DEPTH + '{"api_token": "t-'), k, F.lit('", "name": "'), "c_name", F.lit('", "note": "see https://bob:hunter2@h.test/'), k, F.lit('", "Secret": {"count": '), k,
        F.lit(', "pwd": "p\\"w"}, "list": ["\\"token\\": \\"kept\\"", {"auth": ["plain", 1]}, "s3cr3t-value and tok/en"], "password": "a", "password": "b\\\\", "k\\u0065y": "x", "note2": null}' + "]}" * DEPTH))
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    spread = customers.repartition(max(1, -(-customers.count() // RECORDS)))
    return spread.select(F.col("c_custkey").alias("id"), M.redact_json(record, ["s3cr3t-value", "tok/en", "x"]).alias("record"))


# --- media --------------------------------------------------------------------------------

def media_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("20"), k % 20 + 10, F.lit("/"), F.when(k % 9 == 0, "Img").otherwise("img"), F.when(k % 4 == 0, k).otherwise(k - k % 4),
                 F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("-"), k % 4, F.lit("00x100"))), F.lit(".jpg")).alias("path"), F.col("p_size").cast("bigint").alias("size"))


def media_refs(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        (o * 10 + F.col("l_linenumber")).alias("ref_id"),
        F.concat(F.lit("20"), (k + F.when(o % 3 == 0, 1).otherwise(0)) % 20 + 10, F.lit("/img"), k, F.when(o % 5 == 0, "-200x100").otherwise(""), F.lit(".jpg")).alias("path"))


MEDIA = """
files AS (SELECT path, lower(path) AS low, lower(regexp_extract(path, '[^/]*$')) AS name, regexp_replace(path, '-\\d+x\\d+(\\.jpg)$', '\\1') AS parent, regexp_matches(path, '-\\d+x\\d+\\.jpg$') AS der FROM (
  SELECT '20' || (p_partkey % 20 + 10) || '/' || CASE WHEN p_partkey % 9 = 0 THEN 'Img' ELSE 'img' END || (p_partkey - p_partkey % 4) ||
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '-' || p_partkey % 4 || '00x100' END || '.jpg' AS path FROM part)),
refs AS (SELECT DISTINCT '20' || ((l_partkey + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 20 + 10) || '/img' || l_partkey || CASE WHEN l_orderkey % 5 = 0 THEN '-200x100' ELSE '' END || '.jpg' AS path
  FROM lineitem),
casc AS (SELECT r.path, e.path AS exact, (SELECT max(f.path) FROM files f WHERE f.low = lower(r.path)) AS other, (SELECT count(*) FROM files f WHERE f.name = lower(regexp_extract(r.path, '[^/]*$'))) AS copies
  FROM refs r LEFT JOIN files e ON e.path = r.path),
st AS (SELECT *, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN other IS NOT NULL THEN 'case' WHEN copies > 0 THEN 'name' ELSE 'missing' END AS step FROM casc),
used AS (SELECT f.parent FROM files f JOIN st ON step = 'exact' AND f.path = exact UNION SELECT f.parent FROM files f JOIN st ON step = 'case' AND f.path = other
  UNION SELECT f.parent FROM files f JOIN st ON step = 'name' AND f.name = lower(regexp_extract(st.path, '[^/]*$')))
"""


@query("media_cascade", f"WITH {MEDIA} SELECT step, count(*) AS n, CAST(sum(CASE step WHEN 'name' THEN copies WHEN 'missing' THEN 0 ELSE 1 END) AS BIGINT) AS n_files FROM st GROUP BY 1")
def media_cascade(spark: SparkSession, d: str) -> DataFrame:
    found = media.cascade(media_refs(spark, d), media.visible_files(media_files(spark, d)))
    return found.groupBy("step").agg(F.count("*").alias("n"), F.sum("n_files").alias("n_files"))


@query("media_reconcile", f"""
WITH {MEDIA}
SELECT 'present' AS class, path, CASE WHEN der THEN 'derivative' ELSE 'original' END AS detail FROM files WHERE parent IN (SELECT parent FROM used)
UNION ALL SELECT 'unused', path, CASE WHEN der THEN 'derivative' ELSE 'original' END FROM files WHERE parent NOT IN (SELECT parent FROM used)
UNION ALL SELECT 'missing', path, CASE WHEN path LIKE '%-200x100.jpg' THEN 'derivative' ELSE 'original' END FROM st WHERE step = 'missing'
UNION ALL SELECT 'broken_derivative', path, CASE WHEN parent IN (SELECT parent FROM used) THEN 'used' ELSE 'unused' END FROM files WHERE der AND parent NOT IN (SELECT path FROM files)
UNION ALL SELECT 'collision', name, CASE WHEN count(DISTINCT low) = 1 THEN 'Case Conflict' ELSE 'Path Divergence' END FROM files GROUP BY name HAVING count(*) > 1""")
def media_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return media.reconcile(media_refs(spark, d), media_files(spark, d))
