"""Reference resolution, bracket matching, block grammar and content records on small cases."""

import json
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import url as U
from fleetlens.operators import blocks, dom, links
from fleetlens.operators.brackets import paired

BASE = "http://a/b/c/d;p?q"
# The examples of RFC 3986, section 5.4, and what browsers make of special cases.
CASES = [(BASE, r) for r in ("g", "./g", "g/", "/g", "//g", "?y", "g?y", "g;x", ";x", "g;x?y", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g",
                             "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y",
                             "g?y/./x", "g?y/../x")]
SPECIAL = [
    (BASE, "#s", "http://a/b/c/d;p?q"), (BASE, "g#s/./x", "http://a/b/c/g"), (BASE, "HTTPS://X.Example:443/p", "https://x.example/p"), (BASE, "//h:80", "http://h/"),
    (BASE, "//u@H:81/x", "http://u@h:81/x"), (BASE, "\\x\\y", "http://a/x/y"), (BASE, " g\n ", "http://a/b/c/g"), (BASE, "%2E%2e/g", "http://a/b/g"),
    (BASE, "a b\"<>", "http://a/b/c/a%20b%22%3C%3E"), (BASE, "é?ü", "http://a/b/c/%C3%A9?%C3%BC"), (BASE, "http:g", "http://a/b/c/g"), ("http://a", "x", "http://a/x"),
    ("http://a?q", "", "http://a/?q"), (BASE, "?", "http://a/b/c/d;p?"), (BASE, "mailto:x@y.z", None), (BASE, "data:,x", None), ("", "x", None), (None, "http://a/", "http://a/"),
    ("/rel", "x", None), (BASE, "http://", None), (BASE, "javascript:void(0)", None), (BASE, None, "http://a/b/c/d;p?q")]


def test_resolve(spark):
    want = [(b, r, urljoin(b, r) if not r.startswith("//") else f"http:{r}/") for b, r in CASES] + SPECIAL
    # urljoin keeps an empty path and dots that climb over the root; browsers don't.
    got = spark.createDataFrame(want, "b string, r string, want string").withColumn("got", U.resolve(F.col("b"), F.col("r"))).collect()
    climbed = {"../../../g": "http://a/g", "../../../../g": "http://a/g", "/../g": "http://a/g"}
    assert [(x.r, x.got) for x in got] == [(x.r, climbed.get(x.r, x.want)) for x in got]


def test_typed_links(spark):
    html = """<BASE HREF="/dir/"><a href="x">1</a><a href='x#y'>2</a><a href=../z?a=1&amp;b>3</a><a name=n><img src="i.png"><img data-src="no.png">
    <link rel="StyleSheet" href="s.css"><link rel=icon href=i.ico><script src="//cdn.example/j.js"></script><a href="#here">h</a><a href="tel:1">t</a>"""
    rows = spark.createDataFrame([(1, "https://e.example/p/q", html), (2, None, '<a href="http://x.example">x</a><a href="y">'), (3, "https://e.example", None)],
                                 "page_id int, url string, html string")
    got = sorted((r.page_id, r.type, r.url, r.raw) for r in links.typed_links(rows, "page_id").collect())
    assert got == [(1, "anchor", "https://e.example/dir/x", "x"), (1, "anchor", "https://e.example/z?a=1&b", "../z?a=1&b"),
                   (1, "image", "https://e.example/dir/i.png", "i.png"), (1, "script", "https://cdn.example/j.js", "//cdn.example/j.js"),
                   (1, "stylesheet", "https://e.example/dir/s.css", "s.css"), (2, "anchor", "http://x.example/", "http://x.example")]


def test_paired_is_a_stack(spark):
    draw, rows, want = random.Random(1), [], {}
    for doc in range(30):
        stack = []
        for at in range(draw.choice([1, 5, 40])):
            step = draw.choice([1, 1, -1, -1, 0])
            rows.append((doc, at, step))
            want[doc, at] = [len(stack), False, None]
            if step == 1:
                stack.append(at)
            elif step == -1 and stack:
                opened = stack.pop()
                want[doc, at][0], want[doc, at][2], want[doc, opened][2] = len(stack), opened, at
            elif step == -1:
                want[doc, at][1] = True
    draw.shuffle(rows)
    got = paired(spark.createDataFrame(rows, "doc int, at int, step int"), "doc").collect()
    assert {(r.doc, r.at): [r.level, r.stray, r.partner] for r in got} == want


def stack_parse(markup):
    """(census rows, error rows) by a stack."""
    found, errors, stack = [], [], []
    for at, m in enumerate(re.finditer(blocks.BLOCK, markup or "")):
        closer, name, attrs, single = m.groups()
        name = name if "/" in name else f"core/{name}"
        if closer:
            if not stack:
                errors.append((at, "unbalanced_closer", name, None))
            else:
                _, opened = stack.pop()
                if opened != name:
                    errors.append((at, "mismatched_closer", name, opened))
            continue
        if attrs:
            try:
                json.loads(attrs)
            except ValueError:
                errors.append((at, "invalid_attributes", name, None))
        found.append((at, name, len(stack), stack[-1][1] if stack else None))
        if not single:
            stack.append((at, name))
    return found, errors + [(at, "unclosed_block", name, None) for at, name in stack]


def test_block_grammar(spark):
    tokens = ["<!-- wp:group -->", "<!-- /wp:group -->", "<!-- wp:x/y {\"a\":{\"b\":1}} -->", "<!-- /wp:x/y -->", "<!-- wp:image {\"id\":1} /-->",
              "<!-- wp:list {a} -->", "<!-- more -->", "<p>t</p>", "<!--wp:no -->", "<!-- wp:Upper -->"]
    draw = random.Random(2)
    docs = [(i, "\n".join(draw.choices(tokens, k=draw.choice([0, 1, 6, 60])))) for i in range(40)] + [(98, None), (99, "<!-- /wp:group -->" * 3 + "<!-- wp:a -->" * 300)]
    df = spark.createDataFrame(docs, "doc int, markup string")
    got = {(r.doc, r.at, r.name, r.depth, r.parent) for r in blocks.blocks(df, "doc").collect()}
    errors = {(r.doc, r.at, r.rule, r.name, r.opened) for r in blocks.block_errors(df, "doc").collect()}
    assert got == {(d, *x) for d, m in docs for x in stack_parse(m)[0]}
    assert errors == {(d, *x) for d, m in docs for x in stack_parse(m)[1]}
    assert blocks.census(blocks.blocks(df.limit(0), "doc")).count() == 0


@pytest.mark.parametrize("html, selector, headings, images, links_, text", [
    ("<body><nav><a href=n>n</a></nav><h2>A <b>b</b></h2><p>t <img src=i.png alt=x><a href='../y'>y</a><footer>f</footer></body>", "body",
     [("h2", "A b")], [("http://e.example/d/i.png", "x")], ["http://e.example/y"], "A bt y"),
    ("<div class='big entry-content'>one<main><article><h1>T</h1>x &amp; y<article>in</article></article>out</main></div>", "article", [("h1", "T")], [], [], "Tx & yin"),
    ("<main>a<h2>open <a href=#f>l</a><h3>next</h3>z</main>b", "main", [("h2", "open l"), ("h3", "next")], [], ["http://e.example/d/p"], "aopen lnextz"),
    ("<main>never closed <script>var x = '<p>'</script><style>p{}</style><!-- <a href=no> -->end", "main", [], [], [], "never closed end"),
    ("</main>no content here<p>", None, [], [], [], ""), ("", None, [], [], [], ""), (None, None, [], [], [], ""),
])
def test_main_content(spark, html, selector, headings, images, links_, text):
    rows = spark.createDataFrame([(1, "http://e.example/d/p", html)], "page_id int, url string, html string")
    r = dom.main_content(rows, "page_id").first()
    assert (r.selector, r.text) == (selector, text)
    assert [tuple(x) for x in r.headings or []] == headings and [tuple(x) for x in r.images or []] == images and (r.links or []) == links_
