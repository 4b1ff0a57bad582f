import pytest
from pyspark.sql import functions as F

from fleetlens.functions import html as H, mask as M, sqltext as Q, text as X, url as U, version as V
from fleetlens.operators.crawls import normalized_field
from fleetlens.operators.disk import excluded, ignored
from fleetlens.operators.media import is_media
from fleetlens.plans.probes import _same_target
from fleetlens.plans.schedule import normal_schedule, script_path


@pytest.mark.parametrize("sql, want", [
    ("SELECT * FROM t WHERE id = 123 AND hex_col = 0xabcdef AND price = -45.67e-2", "select * from t where id = ? and hex_col = ? and price = ?"),
    ("SELECT a FROM t WHERE id IN (1,2,3,4,5)", "select a from t where id in (?)"),
    ("INSERT INTO t VALUES (1,'a'), (2,'b')", "insert into t values (?), (?, ?)"),
    ("SELECT 'John''s Phone', `na'me` FROM `t`", "select ?, na'me from t"),
    (r"SELECT 'John\'s Phone'", "select ?"),
    ("SELECT /* x 'y */ 1 -- z\n, \"q\";", "select ?, ?"),
    ("SELECT col1, t2.x3 FROM t_9 WHERE a='open", "select col1, t2.x3 from t_9 where a = ?"),
    ("   # only a comment", ""),
])
def test_digest(one, sql, want):
    assert one(Q.normalize, s=sql) == want


def test_digest_of_a_long_literal_and_list(one):
    text = "SELECT '" + "ab''c\\'" * 20000 + "' FROM t WHERE id IN (" + ",".join(map(str, range(20000))) + ")"
    assert one(Q.normalize, s=text) == "select ? from t where id in (?)"


def test_candidate_index(spark):
    from fleetlens.operators.statements import index_candidates
    rows = [("d1", "select * from a x join b y on x.i = y.i where x.p = ? and y.q = ? and y.r = ? and y.s > ? order by y.z"),
            ("d2", "select * from t where v > ? order by ts"), ("d3", "select * from t where a = ? order by b, c limit ?"), ("d4", "select ? from t")]
    got = {r.digest: (r.tbl, r.cols) for r in index_candidates(spark.createDataFrame(rows, "digest string, normalized string")).collect()}
    assert got == {"d1": ("b", ["q", "r", "s"]), "d2": ("t", ["v"]), "d3": ("t", ["a", "b", "c"])}


@pytest.mark.parametrize("path, want", [("a/b/c.txt", [".", "a", "a/b"]), ("file.txt", ["."]), (".", []), ("", [])])
def test_ancestors(one, path, want):
    assert one(U.ancestors, p=path) == want


@pytest.mark.parametrize("url, want", [
    ("https://example.com/blog/hello?x=1#y", "/blog/hello?x=1"), ("/about-us", "/about-us"), ("", "/"), (None, "/"), ("https://example.com", "/"), ("page", "/page")])
def test_relative_path(one, url, want):
    assert one(U.relative_path, u=url) == want


@pytest.mark.parametrize("url, want", [
    ("https://a.test/x/?b=2&a=1&&#f", "/x?a=1&b=2"), ("https://a.test", "/"), ("/x//", "/x"), ("", ""), ("https://a.test/?", "/")])
def test_compare_path(one, url, want):
    assert one(U.compare_path, u=url) == want


@pytest.mark.parametrize("url, want", [
    ("HTTPS://x", "/https://x"), ("https://a.test/Caf%C3%A9/?b=2&a=1&a=0", "/café?a=1&a=0&b=2"), ("/a+b%20c/", "/a+b c"), ("/bad%zz", "/bad%zz"),
    ("about", "/about"), ("/", "/"), ("//", "/"), ("", "")])
def test_match_path(one, url, want):
    assert one(U.match_path, u=url) == want


def test_match_path_composes_unicode(one):
    assert one(lambda u: U.match_path(u, unicode_form=True), u="/café") == "/café"


def test_url_parts(one):
    assert one(U.crawl_url, u="HTTP://Ex.COM/A?b#c") == "http://ex.com/A?b"
    assert one(U.host, u="https://user@Ex.com:8080/x") == "ex.com"
    assert one(U.registered_domain, u="a.b.example.com") == "example.com"
    assert one(U.slug, u="https://x.test/a/Hello-World.html?x=1") == "hello-world"
    assert one(U.title_from_url, u="/a/hello_big-world.html") == "Hello Big World"
    assert one(U.page_slug, u="https://x.test/") == "index"
    assert one(U.upload_path, u="https://s.test/wp-content/uploads/2023/01/a%20b.jpg?x#y") == "2023/01/a b.jpg"
    assert one(U.image_parent, u="2023/01/image-150x150.jpg.webp") == "2023/01/image.jpg.webp"
    assert one(U.image_size, u="image-150x150.jpg") == "150x150" and one(U.image_size, u="image.jpg") is None
    assert one(is_media, u="https://x/a.JPG?v=1") and not one(is_media, u="https://x/a.html?x=.jpg")


@pytest.mark.parametrize("name, host, want", [
    ("*.example.com", "a.example.com", True), ("*.example.com", "a.b.example.com", False), ("*.example.com", "example.com", False), ("DNS:a.test", "A.test", True)])
def test_cert_name(one, name, host, want):
    assert one(U.cert_name_matches, p=name, h=host) is want


@pytest.mark.parametrize("a, b, want", [("6.5", "6.5.0", False), ("6.5", "6.10", True), ("", "1", True), ("6.5.2-beta3", "6.5.2", False)])
def test_version_less(one, a, b, want):
    assert one(V.less_than, a=a, b=b) is want


@pytest.mark.parametrize("a, b, want", [
    ("2.28.0", "2.32.0", "minor"), ("v1.2", "2", "major"), ("1.2.3-beta", "1.2.4", "patch"), ("2.0", "1.9", "none"), ("dev", "1", "unknown"), (None, "1", "unknown"), ("1.2.3.4", "1.2.3", "none")])
def test_jump(one, a, b, want):
    assert one(V.jump, a=a, b=b) == want


def test_older_than(one):
    assert one(V.older_than, a="2.9-rc", b="2.10") and not one(V.older_than, a="2.10.0", b="2.10")


def test_masks(one):
    assert [one(M.mask, s=s) for s in ("12345678", "123456789", "123456789012345")] == ["****", "12****89", "123****2345"]
    assert one(M.masked_preview, m="key=123456789012345", s="123456789012345") == "key=123****2345"
    assert one(M.redact_text, s="mysql://u:pw@h --password=abc run --token xyz") == "mysql://[REDACTED]@h --password=[REDACTED] run --token [REDACTED]"
    assert one(lambda s: M.redact_known(s, ["abc", "abcdef"]), s="x abcdef y") == "x [REDACTED] y"


@pytest.mark.parametrize("value, want", [("", "empty"), (" Yes ", "bool"), ("-1.5", "number"), ("https://x", "url"), ("1.2.3", "string")])
def test_shape(one, value, want):
    assert one(X.value_shape, v=value) == want


def test_text(one):
    assert abs(one(X.entropy, s="aabb") - 1.0) < 1e-12 and one(X.entropy, s="") == 0
    assert one(X.word_count, s="<p>a b</p> c") == 3 and one(X.word_count, s="<br>") == 0
    assert one(X.clean_title, s="  Hello,  World! ") == "hello world"
    assert one(X.placeholders, s="%d of {n} %s") == ["%d", "%s", "{n}"]
    assert [one(X.tags_imbalanced, s=s) for s in ("<b>x</b>", "<b>x", "</b>", "<b><i></b></i>", "<br/>x")] == [False, True, True, True, False]
    assert one(lambda s: X.round_half_up(s.cast("double")), s="-2.5") == -2
    assert one(X.looks_like_config, s="DB_HOST=1") and not one(X.looks_like_config, s="<html>DB_HOST=1</html>")
    assert one(X.regex_unsafe_shape, s="(a+)+") and not one(X.regex_unsafe_shape, s="^/a$")


@pytest.mark.parametrize("field, a, b", [
    ("robots", "noindex, Follow", "follow,noindex"), ("language", "en_US", "en-us"), ("H1", '["b  x", "a"]', "a\nb x"),
    ("schema_types", '{"@type": "Product", "o": [{"@type": ["Offer", "Thing"]}]}', "Offer, Thing,Product"), ("schema_types", '["B", "A"]', "A,B"),
    ("canonical", "https://a.test/x/", "/x"), ("title", " a  b ", "a b")])
def test_normalized_field(one, field, a, b):
    left, right = (one(lambda v: normalized_field(field, v), v=v) for v in (a, b))
    assert left == right != ""


def test_schedule_parts(one):
    assert one(normal_schedule, s=" @Daily ") == "0 0 * * *" and one(normal_schedule, s="5  *  * * *") == "5 * * * *"
    assert one(script_path, s="A=1 B=2 /usr/bin/x.sh --y") == "/usr/bin/x.sh" and one(script_path, s='"/a b/c" d') == "/a b/c"


def test_path_filters(one):
    assert one(lambda p: excluded(p, ["/a/b"], ["*.log", ".git"]), p="/a/b/c") and one(lambda p: excluded(p, [], ["*.log"]), p="/x/y.log")
    assert not one(lambda p: excluded(p, ["/a/b"], []), p="/a/bc") and one(lambda p: excluded(p, [], [".git"]), p="/x/.git/config")
    assert one(ignored, p="x/node_modules/y") and one(lambda p: ignored(p, ["src/*.min.js"]), p="src/a.min.js") and not one(lambda p: ignored(p, ["src/*.js"]), p="src/a/b.js")


def test_redirect_target(one):
    assert one(_same_target, e="/new", a="https://x.test/new/?q=1") and not one(_same_target, e="/new?q=2", a="/new?q=1")
    assert one(_same_target, e="https://x.test/a/", a="https://x.test/a") and not one(_same_target, e="https://x.test/a", a="/a")


PAGE = """<html lang="en"><head><title> A &nbsp;B </title><meta name='Description' content='d'><link href=/c rel="canonical">
<style>a:focus { outline: none }</style></head><body><nav></nav><h1>One</h1><img src=/i.png><img src="/j.png" alt>
<form><label for="q">Q</label><input id=q><input name=r type="text"><input type=hidden><label>S <input name=s></label></form>
<p style="color:#777;background-color:#fff">x</p><a href='/x'>go <b>on</b></a><!-- wp:core/image --><div class="wp-block-columns"></div></body></html>"""


def test_page_facts(one):
    f = one(H.page_facts, h=PAGE)
    assert (f.title, f.description, f.canonical, f.lang, f.h1s) == ("A B", "d", "/c", "en", ["One"])
    assert [(i.src, i.alt) for i in f.images] == [("/i.png", None), ("/j.png", "")]
    assert [(a.href, a.text) for a in f.anchors] == [("/x", "go on")]
    assert len(f.unlabeled) == 1 and "name=r" in f.unlabeled[0]
    assert f.empty_nav and f.landmarks == ["nav"] and f.blocks == ["columns", "image"] and f.colors[0].fg == "#777"


def test_contrast(one):
    assert abs(one(H.contrast, a="#000", b="#ffffff") - 21) < 1e-9 and one(H.contrast, a="#00000", b="#fff") is None


REDACTIONS = [
    ('{"password": "a", "n": 1}', '{"password": "[REDACTED]", "n": 1}'), ('{"a":{"Token" :\n"x\\"y"}}', '{"a":{"Token" :\n"[REDACTED]"}}'),
    ('["password", "x"]', '["password", "x"]'), ('{"key": ["a", {"pwd": "b"}], "key": 5}', '{"key": ["a", {"pwd": "[REDACTED]"}], "key": 5}'),
    ('{"u": "https:\\/\\/me:pw@h/x ftp://a:b@c"}', '{"u": "https:\\/\\/me:[REDACTED]@h/x ftp://a:[REDACTED]@c"}'),
    ('{"t": "my caf\\u00e9-1 and café-1, xy"}', '{"t": "my [REDACTED] and [REDACTED], xy"}'), ('{"to\\u006ben": "x"}', '{"to\\u006ben": "[REDACTED]"}'),
    ('{"t": "\\"password\\": \\"kept\\""}', '{"t": "\\"password\\": \\"kept\\""}'), ('', ''), (None, None), ('plain', 'plain'), ('"', '"'), ('{"a": "b\\', '{"a": "b\\'),
    ('{"secret": "never closed', '{"secret": "[REDACTED]"'), ('{"secret": ""}', '{"secret": "[REDACTED]"}'), ('{"secret": null, "x": "secret"}', '{"secret": null, "x": "secret"}'),
]


@pytest.mark.parametrize("text,want", REDACTIONS)
def test_redact_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(M.redact_json(F.col("t"), ["café-1", "xy"])).first()[0] == want


def test_redact_json_against_a_walk(spark):
    """Random records against a recursive walk over the parsed value; long strings and deep nests pass."""
    import json
    import random
    import re

    def walk(v, hidden=False):
        if isinstance(v, str):
            return "[REDACTED]" if hidden else v.replace("s3cret", "[REDACTED]")
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x, bool(re.search(M.HIDDEN_NAME, k))) for k, x in v.items()} if isinstance(v, dict) else v

    rng = random.Random(9)

    def make(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return [rng.choice(["a\"b", "s3cret \\", "é: \n", ""]), rng.choice([1, None, True, 2.5]), "key"][kind]
        if kind == 3:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["name", "Pass", "a_key_b", "x\"y", "töken", "tok\\en", "TOKEN:"]): make(depth - 1) for _ in range(rng.randrange(4))}

    values = [make(6) for _ in range(200)]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(values)]
    texts += ['{"a":[' * 20_000 + '{"key":"x"}' + "]}" * 20_000, json.dumps({"key": "\"\\" * 200_000, "b": "\"\\" * 200_000})]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    got = {r.i: r.x for r in df.select("i", M.redact_json(F.col("t"), ["s3cret"]).alias("x")).collect()}
    assert [json.loads(got[i]) for i in range(200)] == [walk(v) for v in values]
    assert got[200] == texts[200].replace('"x"', '"[REDACTED]"')
    assert json.loads(got[201]) == {"key": "[REDACTED]", "b": "\"\\" * 200_000}
