import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import graph, history, media, redirects as R, tables as T
from fleetlens.operators.crawls import compare_crawls
from fleetlens.operators.disk import cumulative_sizes, last_per_path, snapshot_diff
from fleetlens.operators.findings import apply_policy, worst_first
from fleetlens.operators.intervals import interval_lookup
from fleetlens.operators.ordered import exact_median, nearest_rank, ordered_scan, ranked
from fleetlens.operators.skew import lookup
from fleetlens.operators.statements import explain_verdicts, from_perf_digests, statement_digests
from fleetlens.plans import freshness, localization
from fleetlens.schemas import PAGE, PERF_DIGEST


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_ordered_scan_against_brute_force(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{rng.randint(0, 5)}", rng.randint(0, 50), i, rng.choice([None, rng.randint(0, 9)])) for i in range(400)]
    df = spark.createDataFrame(data, "key string, ts bigint, seq bigint, v bigint")
    for reverse in (False, True):
        got = {r.seq: (r.run, r.last, r.before, r.total) for r in ordered_scan(
            df, ["key"], ["ts", "seq"], sums={"run": "v"}, carry={"last": "v"}, carry_before={"before": "v"}, totals={"total": "v"}, reverse=reverse, slices=7).collect()}
        state = {}
        for key, ts, seq, v in sorted(data, key=lambda r: (r[1], r[2]), reverse=reverse):
            run, last = state.get(key, (0, None))
            before, run, last = last, run + (v or 0), v if v is not None else last
            state[key] = (run, last)
            want_run = run if any(d[0] == key and d[3] is not None for d in data) else None
            assert (got[seq][0] or 0, got[seq][1], got[seq][2]) == (want_run or 0, last, before), (seq, reverse)
        assert all(got[d[2]][3] == state[d[0]][0] for d in data)


@pytest.mark.parametrize("n", [10, 200_000])
def test_rank_order_at_any_size(spark, n):
    df = spark.range(n).selectExpr("IF(id = 3, null, CAST(id % 977 AS double)) AS total", "concat('d', lpad(id, 7, '0')) AS digest")
    got = {r.digest: r["rank"] for r in ranked(df, [("total", True), ("digest", True)]).collect()}
    want = sorted(((None if i == 3 else i % 977, f"d{i:07}") for i in range(n)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    assert got == {d: k + 1 for k, (_, d) in enumerate(want)} and want[-1] == (None, "d0000003")


def test_percentile_and_median(spark):
    rng = random.Random(2)
    data = [("a" if i % 4 else "b", float(rng.randint(0, 30))) for i in range(203)]
    df = spark.createDataFrame(data, "k string, v double")
    weights = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    p95 = dict(rows(nearest_rank(weights, ["k"], "v", "w", 0.95, "p"), "k", "p"))
    med = dict(rows(exact_median(df, ["k"], "v", "m"), "k", "m"))
    for k in "ab":
        vs = sorted(v for kk, v in data if kk == k)
        n = len(vs)
        assert p95[k] == vs[-(-95 * n // 100) - 1] and med[k] == (vs[(n - 1) // 2] + vs[n // 2]) / 2


def test_lookup_with_hot_keys(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)] + [(None, 99)], "key string, i int")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, v int")
    want = rows(left.join(dim, "key", "left"), "i", "v")
    assert rows(lookup(left, dim, "key", ["i"]), "i", "v") == want
    assert rows(lookup(left, dim, "key", ["i"], how="inner"), "i", "v") == rows(left.join(dim, "key"), "i", "v")
    assert rows(lookup(left, dim.withColumn("n", F.lit(60)), "key", ["i"], weight="n"), "i", "v") == want


def test_alert_suppression_example(spark):
    minutes = [0, 0, 30, 30, 59, 60, 60, 90, 119, 120]
    df = spark.createDataFrame([("k", m, i) for i, m in enumerate(minutes)], "key string, ts bigint, i int")
    out = history.suppress_alerts(df, 60).where("fired")
    assert sorted(r.ts for r in out.collect()) == [0, 0, 60, 60, 120]


def test_alert_suppression_equals_a_walk(spark):
    rng = random.Random(3)
    data = [(f"k{rng.randint(0, 3)}", rng.randint(0, 2000)) for _ in range(600)]
    df = spark.createDataFrame(data, "key string, ts bigint")
    want = set()
    for key in {k for k, _ in data}:
        last = None
        for ts in sorted({t for k, t in data if k == key}):
            if last is None or ts - last >= 37:
                want.add((key, ts))
                last = ts
    assert {tuple(r) for r in history.fired_instants(df, 37).collect()} == want


def test_intervals_merged(spark):
    points = spark.createDataFrame([(i, i) for i in range(60)], "id bigint, v bigint")
    bands = spark.createDataFrame([(10 * i, 10 * i + 4, f"b{i}") for i in range(1, 5)], "lo bigint, hi bigint, label string")
    want = sorted((i, f"b{i // 10}" if 10 <= i < 50 and i % 10 <= 4 else None) for i in range(60))
    assert sorted(tuple(r) for r in interval_lookup(points, bands, "v", "id", ["label"]).select("id", "label").collect()) == want


def test_points_outside_overlapping_intervals(spark):
    from fleetlens.operators.intervals import outside_intervals
    rng = random.Random(5)
    bands = [(rng.choice("ab"), lo, lo + rng.randint(0, 12)) for lo in (rng.randint(0, 90) for _ in range(14))]
    data = [(k, i, v) for i, (k, v) in enumerate((k, v) for k in "abc" for v in range(100))]
    got = outside_intervals(spark.createDataFrame(data, "map string, id int, v bigint"), spark.createDataFrame(bands, "map string, lo bigint, hi bigint"), "v", "id", ["map"])
    assert {r.id for r in got.collect()} == {i for k, i, v in data if not any(b == k and lo <= v <= hi for b, lo, hi in bands)}


def entries(spark, *pairs):
    data = [(i, s, t, 301, "exact", False) for i, (s, t) in enumerate(pairs)]
    return spark.createDataFrame(data, "seq bigint, source string, target string, status int, classification string, required boolean")


def test_redirect_loop_chain_collision(spark):
    loop = R.validation_findings(entries(spark, ("/a", "/b"), ("/b", "/a")))
    assert rows(loop, "rule", "subject", "detail") == [("loop", "/a", "2")] and not R.is_valid(loop).first()[0]
    assert rows(graph.cycles(R.redirect_edges(entries(spark, ("/a", "/b"), ("/b", "/a")))), "position", "node") == [(0, "/a"), (1, "/b")]
    chain = R.validation_findings(entries(spark, ("/a", "/b"), ("/b", "/c")))
    assert rows(chain, "rule", "detail") == [("chain", "/a -> /c")] and R.is_valid(chain).first()[0]
    clash = R.validation_findings(entries(spark, ("/a", "/b"), ("/a", "/c")))
    assert rows(clash, "rule", "subject") == [("collision", "/a")]
    other = R.validation_findings(entries(spark, ("(a+)+", "/x"), ("/y", "https://o.test/"), ("[", "/z"), ("^[", "/q"), ("/", "")))
    assert rows(other, "rule", "subject") == [("external_target", "/y"), ("unresolved_required", "/"), ("unsafe_regex", "(a+)+"), ("unsafe_regex", "^[")]


def test_functional_graph_against_brute_force(spark):
    rng = random.Random(4)
    nodes = list(range(60))
    nxt = {n: rng.choice(nodes) for n in nodes if rng.random() < 0.9}
    nxt = {a: b for a, b in nxt.items() if a != b}
    edges = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in nxt.items()], "src string, dst string")
    resolved, loops = {}, set()
    for src, target in nxt.items():
        seen, last = [src, target], target
        while last in nxt and nxt[last] not in seen:
            last = nxt[last]
            seen.append(last)
        if last != src:
            resolved[f"{src:02}"] = f"{last:02}"
        if last in nxt:
            ring = seen[seen.index(nxt[last]):]
            loops.add(tuple(sorted(f"{n:02}" for n in ring)))
    assert dict(rows(graph.chain_ends(edges), "src", "target")) == resolved
    found = {}
    for loop, position, node in rows(graph.cycles(edges), "loop_id", "position", "node"):
        found.setdefault(loop, []).append((position, node))
    assert {tuple(sorted(n for _, n in ms)) for ms in found.values()} == loops
    for members in found.values():
        ring = [n for _, n in sorted(members)]
        assert all(f"{nxt[int(a)]:02}" == b for a, b in zip(ring, ring[1:] + ring[:1]))


def test_dependency_levels_with_cycle(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "g"), ("g", "g")], "src string, dst string")
    levels = graph.dependency_levels(nodes, edges)
    assert dict(rows(levels, "node", "level")) == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": 0}
    assert T.conversion_ddl(levels).orderBy("step", "tbl").first().tbl == "a"


def test_match_example(spark):
    src = spark.createDataFrame([
        ("https://o.test/old", "T", "old", ""), ("https://o.test/bye", "T2", "bye", ""), ("https://o.test/x/hello-world", "none", "hello-world", ""),
        ("https://o.test/team", "About Us!", "team", ""), ("https://o.test/p", "Twice", "p", ""), ("https://o.test/q", "nope", "q", "https://o.test/new-q/"),
        ("https://o.test/same/", "zzz", "zz", ""), ("https://o.test/none", "gone fishing", "nix", "")], "url string, title string, slug string, canonical string")
    dst = spark.createDataFrame([
        ("/a/hello-world", "hello-world", "A"), ("/b/hello-world", "hello-world", "B"), ("/about-us", "about-us", "about us"), ("/t1", "t1", "Twice"), ("/t2", "t2", "twice"),
        ("/new-q", "nq", "Q"), ("/SAME", "same", "S")], "url string, slug string, title string")
    over = spark.createDataFrame([("/old", "/new", 302), ("/bye", "gone", 301)], "key string, target string, status int")
    got = {r.source[14:]: (r.target, r.status, r.classification, r.strategy) for r in R.match(src, dst, over).collect()}
    assert got == {
        "/old": ("/new", 302, "exact", "override"), "/bye": ("", 410, "exact", "override"), "/x/hello-world": ("", 301, "ambiguous", "slug"),
        "/team": ("/about-us", 301, "confident", "title"), "/p": ("", 301, "ambiguous", "title"), "/q": ("/new-q", 301, "confident", "canonical"),
        "/same/": ("/SAME", 301, "exact", "exact_path"), "/none": ("", 404, "missing", "none")}


LISTING = "path string, type string, size bigint, mtime double, error string"


def test_rollup_and_diff_example(spark):
    s1 = spark.createDataFrame([(".", "dir", 4096, 1.0, None), ("subdir1", "dir", 4096, 1.0, None), ("file1", "file", 100, 1.0, None), ("subdir1/file2", "file", 200, 1.0, None),
                                ("deleted", "file", 50, 1.0, None), ("subdir1/bad", "file", 9, 1.0, "denied"), ("same", "file", 1, 1.0, None)], LISTING)
    s2 = spark.createDataFrame([(".", "dir", 4096, 1.0, None), ("subdir1", "dir", 4096, 1.0, None), ("file1", "file", 150, 1.0, None), ("subdir1/file2", "file", 120, 1.0, None),
                                ("new_file", "symlink", 80, 1.0, None), ("same", "file", 1, 2.0, None), ("subdir1/bad", "dir", 9, 1.0, None)], LISTING)
    assert dict(rows(cumulative_sizes(s1), "path", "size")) == {".": 351, "subdir1": 200}
    got = {r.path: (r.type, r.status, r.change) for r in snapshot_diff(s1, s2).collect()}
    assert got == {"subdir1": ("dir", "SHRUNK", -80), "file1": ("file", "GROWN", 50), "subdir1/file2": ("file", "SHRUNK", -80), "deleted": ("file", "DELETED", -50),
                   "new_file": ("symlink", "NEW", 80), "same": ("file", "MODIFIED_MTIME", 0), "subdir1/bad": ("dir", "UNCHANGED", 0)}
    twice = s1.where("path = 'file1'").withColumn("seq", F.lit(1)).unionByName(s2.where("path = 'file1'").withColumn("seq", F.lit(2)).withColumn("path", F.lit("file1")))
    assert rows(last_per_path(twice), "size") == [(150,)]


CRAWL = "seq int, url string, status string, title string, description string, canonical string, robots string, language string, H1 string, schema_types string, content_fingerprint string"


def test_metadata_compare_example(spark):
    old = spark.createDataFrame([
        (1, "https://o.test/", "200", "Home", "d", None, "index,follow", "en_US", "H", "WebPage", "f"), (2, "https://o.test/duplicate", "200", "D", "", "", "", "", "", "", ""),
        (3, "https://o.test/duplicate", "200", "late", "", "", "", "", "", "", ""), (4, "https://o.test/about", "200", "About", "", "", "", "", "", "", "")], CRAWL)
    new = spark.createDataFrame([
        (1, "https://n.test/", "200", "Home!", "d", None, "follow, index", "en-us", "H", "WebPage", "f"), (2, "https://n.test/pricing", "200", "P", "", "", "", "", "", "", ""),
        (3, "https://n.test/team", "200", "About", "", "", "", "", "", "", "")], CRAWL)
    pairs = spark.createDataFrame([(1, "https://o.test/about", "https://n.test/team"), (2, "https://o.test/nowhere", "https://n.test/team")], "seq int, src string, dest string")
    got = rows(compare_crawls(old, new, pairs), "url_before", "url_after", "field", "severity")
    assert got == sorted([
        ("https://o.test/", "https://n.test/", "title", "error"), ("https://o.test/duplicate", None, "duplicate", "warning"), ("https://o.test/duplicate", None, "mapping", "warning"),
        (None, "https://n.test/pricing", "mapping", "warning"), ("https://o.test/nowhere", "https://n.test/team", "mapping", "warning"),
        ("https://o.test/nowhere", "https://n.test/team", "duplicate", "warning")], key=repr)
    assert rows(compare_crawls(old, new, None, {"mapping": "ignore", "duplicate": "ignore", "title": "ignore"}), "field") == []


def test_media_example(spark):
    files = spark.createDataFrame([(p, 1) for p in (
        "2023/01/image1.jpg", "2023/01/image1-150x150.jpg", "2023/02/image2.png", "2023/01/collision.jpg", "2023/02/collision.jpg", "2023/03/broken-150x150.jpg",
        "2023/03/orphan.png", ".hidden", "2023/index.php")], "path string, size bigint")
    refs = spark.createDataFrame([(1, "2023/01/image1.jpg", None), (2, "2023/02/Image2.png", None), (3, "2022/12/collision.jpg", None), (4, "2023/01/lost.jpg", None), (5, None, 7), (6, None, 8)],
                                 "ref_id int, path string, attachment_id bigint")
    known = spark.createDataFrame([(7, "2023/01/missing-300x300.jpg")], "attachment_id bigint, path string")
    got = rows(media.reconcile(media.resolve_ids(refs, known), files), "class", "path", "detail")
    assert got == sorted([
        ("present", "2023/01/image1.jpg", "original"), ("present", "2023/01/image1-150x150.jpg", "derivative"), ("present", "2023/02/image2.png", "original"),
        ("present", "2023/01/collision.jpg", "original"), ("present", "2023/02/collision.jpg", "original"), ("unused", "2023/03/broken-150x150.jpg", "derivative"),
        ("unused", "2023/03/orphan.png", "original"), ("missing", "2023/01/lost.jpg", "original"), ("missing", "2023/01/missing-300x300.jpg", "derivative"),
        ("broken_derivative", "2023/03/broken-150x150.jpg", "unused"), ("collision", "collision.jpg", "Path Divergence")], key=repr)
    html = spark.createDataFrame([("p", "<img src='/wp-content/uploads/a.jpg?x' srcset=\"/wp-content/uploads/b-1x1.png 1x, c.webp 2x\"><i style=\"background:url('d.gif')\"><a href='x.html'>")], "source string, html string")
    assert rows(media.html_references(html), "path", "context") == [("a.jpg", "attribute"), ("b-1x1.png", "srcset"), ("c.webp", "srcset"), ("d.gif", "style")]
    meta = spark.createDataFrame([("a", "2023/01/p.jpg", 's:4:"file";s:9:"p-1x1.jpg";')], "source string, path string, metadata string")
    assert rows(media.thumbnail_references(meta), "path") == [("2023/01/p-1x1.jpg",)]


def test_freshness_example(spark):
    pages = spark.createDataFrame([
        ("https://s.test/", "Home", "d", "2024-05-01", ["H1: a", "H2: b"], "w " * 400, ["/a", "/b"], ""), ("https://s.test/a", "Same", "", "2020-01-01", ["H2: x", "H4: y"], "short", ["/a", "https://s.test/b"], ""),
        ("https://s.test/b", " same ", "", None, [], "w " * 400, [], ""), ("https://s.test/lonely", "L", "", "not a date", ["H1: a", "H1: b"], "w " * 400, [], "")], PAGE)
    found = freshness.findings(pages, freshness.Config(), "2024-06-01T00:00:00Z")
    assert rows(found, "entity_id", "rule") == sorted([
        ("/a", "stale_content"), ("/a", "thin_content"), ("/a", "missing_h1"), ("/a", "non_sequential_headings"), ("/a", "duplicate_title"), ("/b", "duplicate_title"),
        ("/b", "unknown_date"), ("/b", "no_headings"), ("/lonely", "unknown_date"), ("/lonely", "multiple_h1s"), ("/lonely", "orphan_page")], key=repr)
    assert dict(rows(freshness.priorities(found), "entity_id", "priority"))["/a"] == 220
    shuffled = freshness.findings(pages.repartition(7, F.rand(1)), freshness.Config(), "2024-06-01T00:00:00Z")
    assert rows(shuffled, "entity_id", "rule", "message") == rows(found, "entity_id", "rule", "message")
    assert worst_first(found).first().severity == "Critical"


def test_statement_filter_and_perf_digests(spark):
    log = spark.createDataFrame([(i, f"SELECT {i}", float(i), None, 10) for i in range(1, 21)] + [(99, "-- x", 1.0, 1, 1)], "seq bigint, sql string, query_ms double, rows_sent bigint, rows_examined bigint")
    row = statement_digests(log).first()
    assert (row["count"], row.total_ms, row.mean_ms, row.p95_ms, row.rows_examined, row.examine_ratio, row.sample, row["rank"]) == (20, 210.0, 10.5, 19.0, 200, 200, "SELECT 1", 1)
    assert statement_digests(log, 210.1).count() == 0
    perf = spark.createDataFrame([("SELECT ?", 4, 8e9, 10, 0, None), ("SELECT ? + ?", 0, 1e9, 1, 1, None)], PERF_DIGEST)
    assert rows(from_perf_digests(perf), "count", "total_ms", "mean_ms", "p95_ms", "examine_ratio") == [(4, 8.0, 2.0, 2.0, 10)]
    plans = spark.createDataFrame([("d", 1, "ALL", None, "Using filesort", "t"), ("d", 2, "index", None, "Using temporary; Using filesort", "u"), ("e", 1, "ref", "k", "", "t")],
                                  "digest string, seq int, type string, key string, extra string, tbl string")
    assert rows(explain_verdicts(plans), "digest", "full_scan") == [("d", True)]


def test_localization_example(spark):
    canon = spark.createDataFrame([("A", "Hello {name}"), ("B", "<b>Go</b>"), ("M", "menu"), ("N", "Line"), ("D", "12345")], "id string, text string")
    loc = spark.createDataFrame([("es", "A", "Hola {nam}"), ("es", "B", "<b>Ir"), ("es", "X", "extra"), ("es", "N", "L\\n"), ("es", "D", "12345")], "locale string, id string, text string")
    config = localization.Config(ignores=(localization.Ignore(ids=("X",)), localization.Ignore(checks=("placeholder_drift",), locale="es")))
    assert rows(localization.findings(canon, loc, config), "entity_id", "rule") == [("B", "tag_imbalance"), ("M", "missing_key"), ("N", "line_break_drift")]
    assert ("A", "placeholder_drift") in rows(localization.findings(canon, loc), "entity_id", "rule")


def test_charset_example(spark):
    tables = spark.createDataFrame([("wp_posts", "latin1", "latin1_swedish_ci", "Dynamic"), ("wp_postmeta", "utf8", "utf8_general_ci", "Compact"), ("ok", "utf8mb4", "UTF8MB4_unicode_ci", "Dynamic")],
                                   "tbl string, charset string, collation string, row_format string")
    columns = spark.createDataFrame([("wp_postmeta", "meta_key", "varchar", "utf8", "utf8_general_ci", 255), ("wp_postmeta", "id", "int", None, None, None)],
                                    "tbl string, col string, data_type string, charset string, collation string, length bigint")
    conn = spark.createDataFrame([("character_set_client", "latin1"), ("character_set_results", "utf8mb4"), ("collation_connection", "latin1")], "name string, value string")
    dbs = spark.createDataFrame([("wp", "latin1", "latin1_swedish_ci")], "name string, charset string, collation string")
    found = T.charset_findings(tables, columns, dbs, conn)
    assert rows(found, "object", "severity") == [("character_set_client", "high"), ("wp", "medium"), ("wp_postmeta", "medium"), ("wp_postmeta.meta_key", "high"), ("wp_posts", "medium")]
    parts = spark.createDataFrame([("wp_postmeta", "meta_key", "meta_key", None), ("wp_postmeta", "short", "meta_key", 191)], "tbl string, index_name string, col string, sub_part bigint")
    assert rows(T.index_overflows(tables, columns, parts), "index_name", "bytes", "byte_limit") == [("meta_key", 1020, 767)]


def test_restore_findings(spark):
    counts = spark.createDataFrame([("a", 70), ("b", 0)], "tbl string, rows bigint")
    before = spark.createDataFrame([("a", 100), ("b", 0), ("c", 5)], "tbl string, rows bigint")
    backups = spark.createDataFrame([("dump", 30.0, 10)], "name string, age_hours double, bytes bigint")
    got = rows(T.restore_findings(counts, before, ["a", "z"], ["b"], 20, backups, 24.0, 100), "tbl", "rule")
    assert got == [("a", "shrunk"), ("b", "empty"), ("c", "shrunk"), ("dump", "too_old"), ("dump", "too_small"), ("z", "missing")]


def test_error_classes(spark):
    df = spark.createDataFrame([(429, None, ""), (404, "ETIMEDOUT", ""), (None, "EPIPE", ""), (None, None, "Socket hang up"), (None, None, "bad")], "status int, code string, message string")
    assert [r.retryable for r in history.classify_errors(df).collect()] == [True, False, True, True, False]


def test_policy_drops_ignored(spark):
    df = spark.createDataFrame([("title",), ("robots",), ("new",)], "field string").withColumn("severity", F.lit(""))
    assert rows(apply_policy(df, "field", {"title": "ignore", "robots": "info"}, "warning"), "field", "severity") == [("new", "warning"), ("robots", "info")]


def test_reachability_with_hot_sources(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 20)] + [(101, 0), (500, 501)], "src bigint, dst bigint")
    roots = spark.createDataFrame([(0,)], "node bigint")
    want = rows(graph.reachable(edges, roots), "node", "hops", "via")
    assert len(want) == 59 and max(r[1] for r in want) == 2
    hot = lookup(edges, roots.select(F.col("node").alias("src"), F.lit(True).alias("h")), "src", ["dst"], "inner", hot=roots.select(F.col("node").alias("src")))
    assert hot.count() == 39


@pytest.mark.parametrize("n", [10, 200_000])
def test_lookup_columns_at_any_size(spark, n):
    from fleetlens.operators.skew import lookup as find
    left = spark.range(n).selectExpr("id AS i", "IF(id % 3 = 0, 'hot', concat('k', id)) AS key")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    got = find(left, dim, "key", ["i"])
    assert got.columns == ["i", "key", "v"] and got.count() == n
    assert got.where("v = 1").count() == len(range(0, n, 3)) and got.where("v = 2").count() == 1


@pytest.mark.parametrize("n", [3, 200_000])
def test_interval_lookup_at_any_size(spark, n):
    from fleetlens.operators.intervals import interval_lookup
    bands = spark.range(n).selectExpr("id * 10 AS lo", "id * 10 + 2 AS hi", "concat('x', id) AS label")
    points = spark.createDataFrame([(1, 2.7), (2, 2.0), (3, 10.5), (4, None), (5, -1.0), (6, 21.0)], "id int, v double")
    got = interval_lookup(points, bands, "v", "id", ["label"])
    assert got.columns == ["id", "v", "label"]
    assert {r.id: r.label for r in got.collect()} == {1: None, 2: "x0", 3: "x1", 4: None, 5: None, 6: "x2"}


def test_secrets_in_long_lines_and_files(spark):
    from fleetlens.plans.secrets import file_lines, scan_lines
    key = "AKIA" + "Q" * 16
    long_line = "x " * 50_000 + key + " y" * 50_000
    big = ("plain text of a line\n" * 260_000) + key
    files = spark.createDataFrame([("a.js", long_line), ("b.txt", big)], "file string, text string")
    got = {(r.file, r.line) for r in scan_lines(file_lines(files)).where("rule = 'aws'").collect()}
    assert got == {("a.js", 1), ("b.txt", 260_001)}


def test_json_ld_nodes(spark):
    from fleetlens.operators.nested import json_ld_nodes, json_strings
    page = ['{"@type": "A", "name": "x", "part": [{"name": "old.test"}, {"@id": "k", "@type": ["B", "C"]}], "ref": {"@id": "k"}}', "{broken",
            '{"@context": {"v": "w"}, "@graph": [{"@id": "k", "@type": "D"}, {"@type": "E", "in": {"@type": "F"}}]}', ""]
    deep = "[" * 5000 + "]" * 5000
    docs = spark.createDataFrame([("p", page), ("q", [deep, '{"@type": "G"}'])], "page string, blocks array<string>")
    got = json_ld_nodes(docs, ("old.test",)).collect()
    nodes = sorted((r.page, r.node_index, r.id, r.type, r.parent_id, r.findings) for r in got if r.error is None)
    assert nodes == [("p", 0, "_:b_1", ["A"], None, ["old_domain_reference"]), ("p", 1, "_:b_2", None, "_:b_1", ["missing_type", "old_domain_reference"]),
                     ("p", 2, "k", ["B", "C"], "_:b_1", []), ("p", 3, "k", ["D"], None, ["duplicate_id"]), ("p", 4, "_:b_3", ["E"], None, []),
                     ("p", 5, "_:b_4", ["F"], "_:b_3", []), ("q", 0, "_:b_1", ["G"], None, [])]
    assert sorted((r.page, r.block_index) for r in got if r.error) == [("p", 1), ("q", 0)]
    texts = spark.createDataFrame([("s", '{"a": ["x", {"b": "y"}], "n": 1}'), ("t", "nope"), ("u", None), ("v", '"top"')], "source string, text string")
    assert sorted(map(tuple, json_strings(texts).collect())) == [("s", "a[0]", "x"), ("s", "a[1].b", "y"), ("v", "", "top")]


def test_orders_series_and_retry_after(spark, one):
    from fleetlens.functions.text import retry_after_seconds
    from fleetlens.operators.findings import by_priority, by_project
    pages = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", None)], "entity_id string, priority int")
    assert [r.entity_id for r in by_priority(pages).orderBy("place").collect()] == ["c", "a", "b", "d"]
    deps = spark.createDataFrame([("p", "z", "minor"), ("q", "a", "major"), ("p", "a", "major")], "project string, package string, severity string")
    got = by_project(deps, ("major", "minor"), ["project", "package"]).orderBy("place").collect()
    assert [(r.project, r.package) for r in got] == [("p", "a"), ("q", "a"), ("p", "z")] and got[0].place == 1
    probes = spark.createDataFrame([("h", 2, 1, 20.0, None), ("h", 1, 2, 10.0, 7.0), ("h", 2, 3, 30.0, 8.0)], "host string, ts long, seq long, days double, ms double")
    assert sorted(map(tuple, history.series(probes, ["days", "ms"]).collect())) == [
        ("h", "days", 1, 1, 10.0), ("h", "days", 2, 2, 20.0), ("h", "days", 3, 2, 30.0), ("h", "ms", 1, 1, 7.0), ("h", "ms", 2, 2, 8.0)]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for header, want in (("120", 120), (" 0 ", 0), ("Mon, 01 Jan 2024 00:01:30 GMT", 90), ("Sun, 31 Dec 2023 00:00:00 GMT", 0), ("soon", None), (None, None)):
        assert one(lambda h: retry_after_seconds(h, now), h=header) == want
