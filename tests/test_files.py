"""Sources read from small files; sinks write and read back."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.plans import freshness, packages, probes, schedule, secrets
from fleetlens.sinks import writers as K
from fleetlens.sources import files as R, lines as L


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return str(path)
    return write


SLOW = """/usr/sbin/mysqld, Version: 8.0. started with:
Tcp port: 3306  Unix socket: /tmp/mysql.sock
Time                 Id Command    Argument
# Time: 2024-01-01T00:00:00Z
# User@Host: root[root] @ localhost []  Id: 5
# Query_time: 1.5  Lock_time: 0.25 Rows_sent: 1  Rows_examined: 1000
use shop;
SET timestamp=1704067200;
SELECT *
  FROM orders WHERE id = 1;
# Time: 2024-01-01T00:00:01Z
# User@Host: app[app] @ host []
# Query_time: 0.5  Lock_time: 0 Rows_sent: 2  Rows_examined: 4
# Time: 2024-01-01T00:00:02Z
# Query_time: 0.1  Lock_time: 0 Rows_sent: 0  Rows_examined: 7
# Bytes_sent: 10
SELECT 2;
# administrator command: Quit;
# User@Host: x
SELECT 'no stats';
# Query_time: 0.2  Lock_time: 0 Rows_sent: 0  Rows_examined: 0
FLUSH TABLES;
"""


def test_slow_log(spark, put):
    got = L.slow_log(L.read_lines(spark, put("slow.log", SLOW)))
    assert rows(got, "time", "query_ms", "lock_ms", "rows_sent", "rows_examined", "sql") == [
        ("2024-01-01T00:00:00Z", 1500.0, 250.0, 1, 1000, "SELECT *\n  FROM orders WHERE id = 1;"), ("2024-01-01T00:00:02Z", 100.0, 0.0, 0, 7, "SELECT 2;")]


PATCH = """commit 0123456789abcdef
diff --git a/x b/x
--- a/x
+++ b/src/x.txt
@@ -1,2 +10,3 @@
 keep
-old
+token one
 keep
+token two
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
+not counted
commit fedcba9876543210
+++ b/node_modules/y
@@ -0,0 +1 @@
+ignored
+++ b/z
@@ -0,0 +5,1 @@
+token three
"""


def test_patch_log(spark, put):
    got = L.added_lines(L.read_lines(spark, put("log.txt", PATCH)))
    assert rows(got, "file", "line", "text", "commit") == [
        ("src/x.txt", 11, "token one", "01234567"), ("src/x.txt", 13, "token two", "01234567"), ("z", 5, "token three", "fedcba98")]


def test_env_files_and_drift(spark, put):
    text = "# c\nexport A=\"x # y\"\nB = 1 # note\nB=2\n9BAD=1\nC=\n=no\nD='q'\n"
    got = L.env_values(L.read_lines(spark, put("a.env", text)))
    assert rows(got, "key", "value") == [("A", "x # y"), ("B", "1"), ("B", "2"), ("C", ""), ("D", "q")]
    other = spark.createDataFrame([("prod", "A", "true", 1), ("prod", "B", "7", 2)], "env string, key string, value string, seq bigint")
    both = got.select(F.lit("dev").alias("env"), "key", "value", "seq").unionByName(other)
    assert rows(secrets.env_drift(both, ["dev", "prod"]), "key", "rule", "detail") == [
        ("A", "shape_mismatch", "dev=string,prod=bool"), ("C", "missing_key", "prod"), ("D", "missing_key", "prod")]


def test_schedules(spark, put):
    cron = L.cron_items(L.read_lines(spark, put("crontab", "SHELL=/bin/sh\n# x\n* * * * * root /bin/a.sh --secret=abc\n@daily bob /bin/b\n0 0 * * * root /bin/c.py\nbad line\n")), with_user=True)
    assert rows(cron, "schedule", "owner", "command_or_unit") == [
        ("* * * * *", "root", "/bin/a.sh --secret=abc"), ("0 0 * * *", "root", "/bin/c.py"), ("@daily", "bob", "/bin/b")]
    units = spark.createDataFrame([
        ("/etc/a.timer", "[Unit]\nDescription=x\n[Timer]\nOnCalendar=daily\n[Install]\nX=1\n", 1), ("/lib/a.timer", "[Timer]\nOnCalendar=hourly\n", 2),
        ("/etc/a.service", "[Service]\nUser=u\nExecStart=/bin/run.sh --token=abc\n", 1), ("/etc/b.timer", "[Timer]\nUnit=nope.service\n", 1)], "file string, text string, seq int")
    timers = L.unit_items(units)
    assert rows(timers, "timer_file", "schedule", "service_file", "command_or_unit") == [
        ("a.timer", "daily", "a.service", "/bin/run.sh --token=abc"), ("b.timer", "N/A", None, "nope.service")]
    listing = spark.createDataFrame([("/bin/a.sh", 0o777), ("/bin/b", 0o755), ("/bin/run.sh", 0o775)], "path string, mode int")
    found = schedule.findings(cron.unionByName(timers), listing)
    assert rows(found, "category", "severity", "item") == sorted([
        ("Unusual Frequency", "Warning", "/bin/a.sh --secret=[REDACTED]"), ("Unsafe Executable Permissions", "Critical", "/bin/a.sh --secret=[REDACTED]"), ("Missing Script", "High", "/bin/c.py"),
        ("Unsafe Executable Permissions", "Warning", "/bin/run.sh --token=[REDACTED]"), ("Mismatched State", "Critical", "nope.service"), ("Conflicting Schedule / Overlap", "Warning", "0 0 * * *")], key=repr)


def test_catalogs(spark, put):
    po = 'msgid ""\nmsgstr "Header: x\\n"\n\n#: a.c\nmsgid "a\\n"\n"b"\nmsgstr "x \\"q\\""\n\nmsgid "k"\nmsgstr ""\n'
    assert rows(L.gettext(L.read_lines(spark, put("de.po", po))), "id", "text") == [("a\nb", 'x "q"'), ("k", "")]
    assert rows(R.catalog_json(spark, put("fr.json", {"A": "un", "B": "deux"}), "fr"), "id", "text") == [("A", "un"), ("B", "deux")]
    assert rows(R.catalog_json(spark, put("it.json", [{"key": "A", "value": "uno"}]), "it"), "locale", "id", "text") == [("it", "A", "uno")]
    assert rows(R.catalog_csv(spark, put("es.csv", 'note,ID,Text\n-,A,"x, ""y"""\n-,,z\n'), "es"), "id", "text") == [("A", 'x, "y"')]


def test_crawls(spark, put):
    csv = "﻿URL,Status,Page Title,Meta Description,code\n https://a/ ,200,T,\"d, \"\"q\"\"\",9\n,200,no url,,\n"
    assert rows(R.crawl_csv(spark, put("before.csv", csv)), "url", "status", "title", "description", "robots") == [("https://a/", "200", "T", 'd, "q"', None)]
    text = '{"url": "https://a/", "status": 200, "Title": "x"}\n{"address": "https://b/", "page_title": "y", "title": ""}\ntorn {\n'
    assert rows(R.crawl_jsonl(spark, put("after.jsonl", text)), "url", "status", "title") == [("https://a/", "200", "x"), ("https://b/", None, "")]


def test_mappings_and_overrides(spark, put):
    want = [("/a", "/b"), ("/c", "/d")]
    assert rows(R.url_mapping(spark, put("m1.csv", "source,destination\n/a,/b\n/c,/d\n")), "src", "dest") == want
    assert rows(R.url_mapping(spark, put("m2.csv", "/a,/b\n/c,/d\n")), "src", "dest") == want
    assert rows(R.url_mapping(spark, put("m3.json", {"/a": "/b", "/c": "/d"})), "src", "dest") == want
    assert rows(R.url_mapping(spark, put("m4.json", [{"Old": "/a", "New": "/b"}, {"from": "/c", "to": "/d"}])), "src", "dest") == want
    assert rows(R.url_mapping(spark, put("m5.jsonl", '{"old": "/a", "new": "/b"}\n{"old": "/c", "new": "/d"}\n')), "src", "dest") == want
    over = [("/old", "/last", 302), ("/x", "gone", 301)]
    assert rows(R.redirect_overrides(spark, put("o1.csv", "source,target,status\n/Old/,/first,301\n/old,/last,302\n/x,gone,\n")), "key", "target", "status") == over
    assert rows(R.redirect_overrides(spark, put("o2.json", {"/OLD": "/first", "/old": {"target": "/last", "status": 302}, "/x": {"status": 301}})), "key", "target", "status") == over
    assert rows(R.redirect_overrides(spark, put("o3.json", [{"old": "/old", "new": "/last", "status": 302}, {"source": "/x", "target": "gone"}])), "key", "target", "status") == over


def test_destinations(spark, put):
    xml = "<urlset><url><loc> https://n/a-b.html </loc></url><url><loc>https://n/c/</loc></url></urlset>"
    assert rows(R.destinations(spark, put("sitemap.xml", xml)), "url", "slug", "title") == [("https://n/a-b.html", "a-b", "A B"), ("https://n/c/", "c", "C")]
    assert rows(R.destinations(spark, put("list.txt", "# x\n\nhttps://n/c/\n")), "url", "slug") == [("https://n/c/", "c")]
    assert rows(R.destinations(spark, put("d.json", {"urls": ["/x-y", {"url": "/z", "title": "Zed"}]})), "url", "title") == [("/x-y", "X Y"), ("/z", "Zed")]


def test_manifests_and_trees(spark, put, tmp_path):
    pages = {"pages": [{"url": "", "canonical": "/c", "title": "T", "description": "d", "h1": "Hi", "content": "x", "outbound": ["/a"]}, {"title": ""}]}
    got = R.page_manifest(spark, put("manifest.json", pages))
    assert rows(got, "url", "meta_desc", "headings", "links", "slug") == [("/c", "d", ["H1: Hi"], ["/a"], "page-0"), ("/page-1", "", [], [], "page-1")]
    assert rows(R.page_manifest(spark, put("urls.json", {"urls": ["/a", "/b"]})), "url", "headings") == [("/a", []), ("/b", [])]
    put("site/pages/home/meta.json", {"url": "/", "headings": ["H1: x"]})
    put("site/pages/home/content.md", "md")
    put("site/pages/home/content.html", "html")
    put("site/pages/a/b/meta.json", "{torn")
    put("site/pages/a/b/content.html", "html")
    assert rows(R.page_tree(spark, str(tmp_path / "site")), "url", "content", "slug") == [("/", "md", "home"), ("/a/b", "html", "b")]


def test_snapshots_and_jsonl(spark, put):
    text = '{"__snapshot_version__": 1, "root_directory": "/", "timestamp": 1.0}\n{"path": "a\\\\b", "type": "file", "size": 5, "mtime": 1.5}\n{"path": "e", "type": "file", "error": "denied"}\n'
    assert rows(R.file_snapshot(spark, put("s.jsonl", text)), "path", "size", "error") == [("a\\b", 5, None), ("e", None, "denied")]
    torn = put("h.jsonl", '{"ts": 1, "results": [{"host": "a", "status": "red"}]}\n{"ts": 2, "res\n')
    assert rows(R.probe_history(spark, torn), "ts", "host", "status") == [(1, "a", "red")]
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        R.jsonl(spark, torn, S.PROBE_RUN, strict=True).collect()


def test_inventories(spark, put, tmp_path):
    put("inv/s1/plugin_list.json", [{"name": "akismet", "status": "active-network", "update": "available", "version": "5.0", "update_version": "5.1"}, {"name": "hello", "status": "inactive", "version": ""}])
    put("inv/s1/core_version.json", [{"name": "core", "version": "6.1"}])
    for name in ("theme_list", "mu_plugins"):
        put(f"inv/s1/{name}.json", [])
    got = R.extensions(spark, str(tmp_path / "inv"))
    assert rows(got, "site", "ext_type", "name") == [("s1", "core", "core"), ("s1", "plugin", "akismet"), ("s1", "plugin", "hello")]
    assert rows(R.multisite(got), "site", "multisite") == [("s1", True)]
    found = packages.policy_findings(got, packages.Policy(min_core_version="6.2"))
    assert rows(found, "entity_id", "rule", "severity") == sorted([
        ("core:core", "core_outdated", "critical"), ("plugin:akismet", "update_available", "high"), ("plugin:hello", "inactive", "medium"), ("plugin:hello", "unknown_version", "medium")])


def test_dependency_reports(spark, put):
    pip = R.dependency_reports(spark, "p", "pip", put("pip.json", [{"name": "requests", "version": "2.28.0", "latest_version": "2.32.0"}]))
    audit = R.audit_reports(spark, "p", "pip", put("audit.json", [{"name": "urllib3", "version": "1", "vulns": [{"id": "X-1", "description": "bad"}]}, {"name": "clean", "vulns": []}]))
    got = packages.classify(packages.dependency_rows(packages.audit_rows(pip, audit)))
    assert rows(got, "package", "severity", "advisories") == [("requests", "minor", 0), ("urllib3", "security", 1)]
    npm = R.dependency_reports(spark, "p", "npm", put("npm.json", {"a": {"current": "1.0.0", "latest": "2.0.0"}, "b": [{"current": "1.0.0", "latest": "1.0.1"}]}))
    assert rows(npm, "package", "current", "latest") == [("a", "1.0.0", "2.0.0"), ("b", "1.0.0", "1.0.1")]
    naudit = R.audit_reports(spark, "p", "npm", put("na.json", {"vulnerabilities": {"a": {"severity": "high", "via": ["x"]}, "b": {"severity": "low", "via": [{"title": "T", "url": "u"}]}}}))
    assert rows(naudit, "package", "id", "title", "severity") == [("a", None, "Known vulnerability in a", "high"), ("b", "u", "T", "low")]
    comp = R.dependency_reports(spark, "p", "composer", put("c.json", {"installed": [{"name": "v/p", "version": "1.0", "latest": "1.1"}]}))
    assert rows(comp, "package", "latest") == [("v/p", "1.1")]
    caudit = R.audit_reports(spark, "p", "composer", put("ca.json", {"advisories": {"v/p": [{"cve": "CVE-1", "title": "t"}], "w": {"0": {"advisoryId": "A"}}}}))
    assert rows(caudit, "package", "id", "title") == [("v/p", "CVE-1", "t"), ("w", "A", "Known vulnerability in w")]


WXR = """<rss xmlns:wp="w" xmlns:content="c" xmlns:excerpt="e"><channel>
<item><title>P</title><wp:post_id>1</wp:post_id><wp:post_type>post</wp:post_type><content:encoded><![CDATA[<img src="/wp-content/uploads/x.jpg">]]></content:encoded>
<wp:postmeta><wp:meta_key>_thumbnail_id</wp:meta_key><wp:meta_value>2</wp:meta_value></wp:postmeta></item>
<item><wp:post_id>2</wp:post_id><wp:post_type>attachment</wp:post_type><wp:attachment_url>https://s/wp-content/uploads/2023/a.png</wp:attachment_url></item></channel></rss>"""


def test_export(spark, put):
    items = R.export_items(spark, put("export.xml", WXR))
    assert rows(R.attachments(items), "attachment_id", "path") == [(2, "2023/a.png")]
    assert rows(R.featured_images(items), "post_id", "attachment_id") == [(1, 2)]
    assert "uploads/x.jpg" in items.where("post_id = 1").first().content


def test_captures(spark, put, tmp_path):
    got = R.responses(spark, put("r.json", {"/": {"status": 200, "headers": {"A": "b"}, "body": "x" * 120, "durationMs": 2500}}))
    checks = spark.createDataFrame([("/", None, "x", None, None, None, None), ("/gone", 404, None, None, None, None, None)],
                                   "path string, expect_status int, contains string, json boolean, redirects_to string, max_ms int, min_bytes int")
    hits = probes.response_checks(checks, got)
    assert rows(hits, "path", "severity", "kind") == [("/", "warn", "slow"), ("/gone", "fail", "no_response")]
    assert tuple(probes.check_summary(checks, hits).first()) == (2, 1, 1, 1)
    put("saved/a.html", "<html>")
    assert rows(R.saved_pages(spark, put("list.json", [{"url": "/a", "file": "saved/a.html"}]), str(tmp_path / "saved")), "url", "html") == [("/a", "<html>")]


def test_catalog_snapshot(spark):
    tables = {
        "SCHEMATA": ("SCHEMA_NAME string, DEFAULT_CHARACTER_SET_NAME string, DEFAULT_COLLATION_NAME string", [("wp", "latin1", "x")]),
        "TABLES": ("TABLE_SCHEMA string, TABLE_NAME string, TABLE_COLLATION string, ROW_FORMAT string", [("wp", "t", "utf8_bin", "Compact"), ("other", "u", "x", "y")]),
        "COLUMNS": ("TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, CHARACTER_SET_NAME string, COLLATION_NAME string, CHARACTER_MAXIMUM_LENGTH int", [("wp", "t", "c", "varchar", "utf8", "utf8_bin", 9)]),
        "STATISTICS": ("TABLE_SCHEMA string, TABLE_NAME string, INDEX_NAME string, COLUMN_NAME string, SUB_PART int, SEQ_IN_INDEX int", [("wp", "t", "i", "b", None, 2), ("wp", "t", "i", "c", None, 1)]),
        "KEY_COLUMN_USAGE": ("TABLE_SCHEMA string, TABLE_NAME string, REFERENCED_TABLE_NAME string", [("wp", "t", "p"), ("wp", "t", None)]),
    }
    flat = R.catalog_snapshot(lambda v: spark.createDataFrame(tables[v][1], tables[v][0]), "wp")
    assert rows(flat["tables"], "tbl", "charset") == [("t", "utf8")] and rows(flat["foreign_keys"], "src", "dst") == [("p", "t")]
    assert rows(R.index_columns(flat["index_parts"]), "columns") == [(["c", "b"],)]


def test_findings_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("/a", 'T "q", x'), ("/b", "U")], "entity_id string, title string")
    found = freshness.evaluate(pages.where("entity_id = '/a'"), "freshness", "page", F.col("entity_id"), [
        freshness._rule("thin_content", F.lit(True), F.lit("m")), freshness._rule("orphan_page", F.lit(True), F.lit("m"))])
    flat = K.with_healthy(pages, found, "entity_id")
    assert rows(flat, "entity_id", "rule", "score") == [("/a", "orphan_page", 100), ("/a", "thin_content", 30), ("/b", "None", 0)]
    K.write_csv(flat, str(tmp_path / "csv"))
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True, escape='"'), "title") == [('T "q", x',), ('T "q", x',), ("U",)]
    report = K.nested_report(pages, found, "entity_id")
    assert [[f.rule for f in r.findings or []] for r in report.orderBy("entity_id").collect()] == [["orphan_page", "thin_content"], []]
    twice = K.nested_report(pages, found.union(found), "entity_id").collect()
    assert sorted(f.times for r in twice for f in r.findings or []) == [2, 2] and len(twice) == pages.count()
    K.write_json(report, str(tmp_path / "json"))
    K.write_findings(found, str(tmp_path / "found"))
    assert spark.read.parquet(str(tmp_path / "found")).where("pack = 'freshness'").count() == 2


def test_history_and_runs(spark, tmp_path):
    run = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b")], "run_date string, host string")
    for _ in range(2):
        K.append_run(run, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    for rid in ("r1", "r2", "r2"):
        K.replace_run(run, str(tmp_path / "runs"), rid)
    assert rows(spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count(), "run_id", "count") == [("r1", 2), ("r2", 2)]


def test_redirect_rules(spark, tmp_path):
    df = spark.createDataFrame([("/a.b", "/c", 301, "exact"), ("/q?x=1", "/r", 302, "exact"), ("/g", "", 410, "exact"), ("/m", "", 404, "missing"), ('/s "p', "/t", 301, "exact")],
                               "source string, target string, status int, classification string")
    got = {r.source: r for r in K.redirect_rules(df).collect()}
    assert set(got) == {"/a.b", "/q?x=1", "/g", '/s "p'}
    assert got["/a.b"].apache == 'Redirect 301 "/a.b" "/c"' and got["/a.b"].nginx_rewrite == "rewrite ^/a\\.b$ /c permanent;" and got["/a.b"].nginx_map == '    "/a.b" "/c";'
    assert got["/q?x=1"].apache == "RewriteCond %{QUERY_STRING} ^x=1$\nRewriteRule ^q$ /r? [R=302,L]"
    assert got["/q?x=1"].nginx_rewrite == 'if ($request_uri = "/q?x=1") {\n    return 302 /r?;\n}'
    assert got["/g"].apache == 'Redirect 410 "/g"' and got["/g"].nginx_map == '    "/g" "gone";'
    assert got['/s "p'].nginx_rewrite.startswith('if ($request_uri = "/s \\"p")')
    K.write_rules(K.redirect_rules(df), "nginx_map", str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules")).count() == 4


def test_envelope(spark):
    hits = spark.createDataFrame([("/", "fail"), ("/a", "warn"), ("/b", None)], "path string, severity string")
    good = K.envelope(hits, "tool", "1", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01Z").select(F.lit("good").alias("source"), F.to_json(F.struct("*")).alias("text"))
    assert good.first().text and K.envelope_violations(good).count() == 0
    bad = spark.createDataFrame([("bad", '{"contract_version": "2", "status": "odd"}'), ("torn", "{")], "source string, text string")
    got = rows(K.envelope_violations(bad), "source", "field", "problem")
    assert ("bad", "status", "not allowed") in got and ("bad", "contract_version", "not allowed") in got and ("bad", "tool", "missing") in got and ("torn", "", "not JSON") in got


def test_streams_append_and_diff(spark, tmp_path):
    from fleetlens.streaming import monitor
    src = tmp_path / "in"
    schema = "run_date string, project string, type string, package string, latest string, security boolean"
    seen = []

    def run(day, latest, security):
        spark.createDataFrame([(day, "p", "npm", "a", latest, security), (day, "p", "npm", "b", "1", False)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        monitor.append_history(stream, str(tmp_path / "hist"), str(tmp_path / "c1")).awaitTermination()
        monitor.new_since_last_run(stream, lambda df, i: seen.append((i, rows(df, "package"))), str(tmp_path / "c2"), str(tmp_path / "runs")).awaitTermination()

    run("d1", "1", False)
    run("d2", "2", False)
    run("d3", "2", True)
    run("d4", "2", True)
    assert seen == [(0, [("a",), ("b",)]), (1, [("a",)]), (2, [("a",)]), (3, [])]
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 8


def test_ordered_streams_over_batches(spark, tmp_path):
    """Three micro-batches; state carries over, open incidents come out, a late alert is marked."""
    from fleetlens.streaming import monitor
    probes = [[("a", 1, 1, "red"), ("a", 2, 2, "red"), ("b", 1, 3, "green")], [("a", 11, 4, "red"), ("b", 12, 5, "red")],
              [("a", 21, 6, "green"), ("a", 22, 7, "red"), ("b", 23, 8, "red")]]
    alerts = [[("k", 0), ("k", 5), ("j", 7)], [("k", 8), ("k", 12)], [("k", 3), ("k", 30), ("j", 16)]]
    for name, data, schema in (("p", probes, "host string, ts bigint, seq bigint, status string"), ("q", alerts, "key string, ts bigint")):
        for part in data:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        run = monitor.incident_stream(stream, str(tmp_path / "i")) if name == "p" else monitor.suppress_alerts(stream, 10, str(tmp_path / "a"))
        run.awaitTermination()
    closed = monitor.results(spark, str(tmp_path / "i"), "closed", monitor.INCIDENT)
    still = monitor.results(spark, str(tmp_path / "i"), "open", monitor.INCIDENT, last=True)
    assert rows(closed.union(still), "host", "start", "end", "runs") == sorted([("a", 1, 21, 3), ("a", 22, None, 1), ("b", 12, None, 2)])
    got = {(r.key, r.ts): (r.fired, r.late) for r in monitor.results(spark, str(tmp_path / "a"), "alerts", monitor.ALERT).collect()}
    assert got == {("k", 0): (True, False), ("k", 5): (False, False), ("j", 7): (True, False), ("k", 8): (False, False), ("k", 12): (True, False),
                   ("k", 3): (False, True), ("k", 30): (True, False), ("j", 16): (False, False)}
