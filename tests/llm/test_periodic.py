"""Periodic runs against a plain search by period, and the query against the same on whole tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from fleetlens.llm.periodic import _runs_of, collapsed, periodic_runs, with_loops
from fleetlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words, least, exponent):
    """For each period the maximal stretches that have it; of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(words)):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def plain_loop(ident, words):
    h, n = zlib.crc32(str(ident).encode()), len(words)
    if h % 10 or not n:
        return words
    a, p = h // 10 % n, 0
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_random_texts():
    draw = random.Random(11)
    for _ in range(1500):
        least, exponent = draw.choice([1, 2, 3, 5, 8, 24]), draw.choice([2, 3, 4])
        texts = []
        for _ in range(draw.randint(0, 5)):
            letters = "abc"[:draw.randint(1, 3)]
            words = [draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 30, 60]))]
            for _ in range(draw.randint(0, 2)):
                at = draw.randint(0, len(words))
                words[at:at] = [draw.choice(letters) for _ in range(draw.randint(1, 6))] * draw.randint(2, 9)
            texts.append([w.encode() for w in words])
        got = list(_runs_of(texts, least, exponent))
        assert got == [plain_runs(t, least, exponent) for t in texts]
        assert [collapsed(t, r) for t, r in zip(texts, got)] == [plain_collapsed(t, r) for t, r in zip(texts, got)]


@pytest.mark.parametrize("words, runs", [
    ([b"a"] * 60_000, [(0, 60_000, 1)]),
    ([b"x%d" % (i % 40) for i in range(50_000)], [(0, 50_000, 40)]),
    ([w for i in range(4000) for w in [b"k%d" % i] + [b"p%d" % j for j in range(17)]], []),
])
def test_very_long_texts(words, runs):
    assert next(_runs_of([words], 24, 3)) == runs


def test_undefined_rows(spark):
    again = "so it goes " * 12
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (None, again), (4, again), (4, again)], "doc_id bigint, text string")
    rows = rows.selectExpr("*", "1 AS Runs", "2 AS collapsed", "3 AS lang")
    out = periodic_runs(rows)
    assert sorted(out.columns) == ["collapsed", "doc_id", "lang", "runs", "text"]
    got = {(r.doc_id, r.collapsed, tuple(tuple(x) for x in r.runs)) for r in out.collect()}
    assert got == {(1, "", ()), (2, "", ()), (3, "", ())} | {(k, "so it goes", ((0, 36, 3),)) for k in (None, 4)}
    assert out.count() == 6 and periodic_runs(rows.limit(0)).count() == 0


def test_loops_leave_rows_without_words(spark):
    zero = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = spark.createDataFrame([(zero, None), (zero, " "), (None, "a b")], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.text or "") for r in with_loops(rows).collect()) == sorted([(zero, ""), (zero, " "), (-1, "a b")])


def test_loops_of_any_white_space(spark):
    draw = random.Random(5)
    idents = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, draw.choice(["", " ", "\n\t"]) + "".join(draw.choice(["a", "bé", "日本", "$1\\"]) + draw.choice([" ", "  ", "\t", "\x0b", "\r\n"])
                                                        for _ in range(draw.choice([1, 2, 3, 9, 60])))) for i in idents]
    got = {r.doc_id: r.text for r in with_loops(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: b" ".join(plain_loop(i, t.encode().split())).decode() for i, t in rows}


def test_loops_leave_little_on_the_heap(spark):
    """Executors' heaps grew by what the loops left there, so what a word leaves is bounded."""
    java = spark._jvm.java.lang
    threads = spark._jvm.javax.management.JMX.newMXBeanProxy(
        java.management.ManagementFactory.getPlatformMBeanServer(), spark._jvm.javax.management.ObjectName("java.lang:type=Threading"),
        java.Class.forName("com.sun.management.ThreadMXBean"))
    words, zero = 400_000, next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = spark.createDataFrame([(zero, "word " * words)], "doc_id bigint, text string")

    def left(df):
        df.selectExpr("max(length(text))").collect()  # the second run finds its code compiled
        before = sum(threads.getThreadAllocatedBytes(threads.getAllThreadIds()))
        df.selectExpr("max(length(text))").collect()
        return sum(threads.getThreadAllocatedBytes(threads.getAllThreadIds())) - before

    assert (left(with_loops(rows)) - left(rows)) / words < 300


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        words = plain_loop(d.doc_id, (d.text or "").encode().split())
        runs = plain_runs(words[:], 24, 3) if len(words) < 3000 else next(_runs_of([words], 24, 3))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs)).hexdigest()
        seen += bool(runs)
    assert seen > 10
