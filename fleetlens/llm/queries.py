"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm.adaptive_join import ngram_components
from fleetlens.llm.bpe import bpe_count, bpe_decode, bpe_encode
from fleetlens.llm.fm_index import contamination
from fleetlens.llm.hyperminhash import near_duplicates
from fleetlens.llm.imatch import compared_with_next, lexicon
from fleetlens.llm.line_dedup import line_dedup
from fleetlens.llm.periodic import periodic_runs, with_loops
from fleetlens.llm.pii import KINDS, find_pii, fit as fit_tagger
from fleetlens.llm.prefix_trie import prefix_trie, sequences, with_shared_heads
from fleetlens.llm.token_counts import length_histogram
from fleetlens.llm.url_filter import page_links, rule_table, url_verdicts
from fleetlens.llm.weak_labels import classify
from fleetlens.llm.wrapper import main_texts

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


@query
def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared_with_next(docs, lexicon(docs, min_share=0.0005, max_share=0.1))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe_encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"])
    digests = ids.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    out = bpe_decode(digests, VOCABULARY, keep=["doc_id", "n_tokens", "ids_sha256"])
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with its suffix sums, one row per length."""
    docs = _table(spark, sf_dir, "documents").select("text")
    return length_histogram(bpe_count(docs, VOCABULARY, public_tokenizers.PATTERN, keep=[]))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE["op4_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
shared AS (
    SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.*, coalesce(k.doc_id < s.last_id, FALSE) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, _table(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    n_hit = F.aggregate("word_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"))


ORACLE["op10_fm_index"] = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
cut AS (
    SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM words),
sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM cut WHERE kind = 'b' AND len(w) > 0),
starts AS (
    SELECT c.kind, c.id, c.w, s.n, unnest(generate_series(1, len(c.w) - s.n + 1)) AS p
    FROM cut c JOIN sizes s ON CASE WHEN c.kind = 'd' THEN len(c.w) >= s.n ELSE least(10, len(c.w)) = s.n END),
windows AS (SELECT kind, id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM starts),
met AS (
    SELECT d.id AS doc_id, d.n, d.p, b.id AS item_id
    FROM windows d JOIN (SELECT DISTINCT id, k FROM windows WHERE kind = 'b') b ON d.kind = 'd' AND d.k = b.k),
hits AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS place FROM met) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT c.id AS doc_id, len(c.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hits h ON h.doc_id = c.id LEFT JOIN items i ON i.doc_id = c.id WHERE c.kind = 'd'
"""


URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    out = url_verdicts(pages.select("page_id", "url"), rule_table(spark, URL_RULES), page_links(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in URL_RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op5_url_filter"] = (r"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES """ + _RULE_ROWS + r"""),
pages_cut AS (
    SELECT page_id, html, url, CASE WHEN url LIKE '%://%' THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest,
           url LIKE '%://%' AS named
    FROM pages),
urls AS (
    SELECT page_id, html, """ + _LOWER.format(r"regexp_extract(rest, '^[^/?#]*')") + r""" AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           CASE WHEN named THEN """ + _LOWER.format(r"regexp_extract(rest, '^[^/?#]*')") + r"""
                || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS plain, url
    FROM pages_cut),
tags AS (
    SELECT page_id, url, html, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS target
    FROM (SELECT page_id, url, html, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*>')) AS tag FROM urls)
    WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
    UNION ALL
    SELECT page_id, url, html, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    FROM (SELECT page_id, url, html, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^>]*>')) AS tag FROM urls)
    WHERE regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
asked AS (
    SELECT DISTINCT url, url AS base, '' AS ref, '' AS target FROM urls WHERE plain IS NOT NULL
    UNION SELECT DISTINCT url, url, replace(replace(target, '&amp;', '&'), '&quot;', '"'), target FROM tags WHERE target <> '' AND url IS NOT NULL),
cut AS (
    SELECT url, target, lower(regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS bs, regexp_extract(base, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)', 1) AS ba,
           regexp_extract(base, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS bp, regexp_extract(base, '^[^?#]*([?][^#]*)', 1) AS bq,
           lower(regexp_extract(ref, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS rs, regexp_extract(ref, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)', 1) AS ra,
           regexp_extract(ref, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS rp, regexp_extract(ref, '^[^?#]*([?][^#]*)', 1) AS rq
    FROM asked),
joined AS (
    SELECT url, target, CASE WHEN rs <> '' THEN rs ELSE bs END AS scheme, CASE WHEN ra <> '' OR rs NOT IN ('', bs) THEN ra ELSE ba END AS authority,
           CASE WHEN ra <> '' OR rs NOT IN ('', bs) OR rp LIKE '/%' THEN rp WHEN rp = '' THEN bp
                WHEN bp LIKE '%/%' THEN regexp_extract(bp, '^.*/') || rp ELSE '/' || rp END AS path,
           CASE WHEN ra <> '' OR rs NOT IN ('', bs) OR rp <> '' OR rq <> '' THEN rq ELSE bq END AS query
    FROM cut),
walked AS (
    SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS segments,
           list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: [s])), lambda done, s:
               CASE replace(lower(s[1]), '%2e', '.') WHEN '..' THEN done[1:len(done) - 1] WHEN '.' THEN done ELSE done || s END) AS done
    FROM joined WHERE scheme IN ('http', 'https') AND len(authority) > 2),
nodes AS (
    SELECT url, target, regexp_replace(lower(substring(authority, 3)), CASE scheme WHEN 'http' THEN ':(80)?$' ELSE ':(443)?$' END, '')
           || coalesce(list_aggregate(list_transform(regexp_extract_all(
               '/' || array_to_string(CASE WHEN replace(lower(segments[-1]), '%2e', '.') IN ('.', '..') THEN list_append(done, '') ELSE done END, '/') || query,
               '[!#-;=?-_a-z|~]+|[^!#-;=?-_a-z|~]+'), lambda s: CASE WHEN regexp_matches(s, '^[!#-;=?-_a-z|~]') THEN s ELSE replace(url_encode(s), '+', '%20') END), 'string_agg', ''), '') AS node
    FROM walked),
named AS (SELECT u.*, coalesce(n.node, u.plain) AS node FROM urls u LEFT JOIN nodes n ON n.url = u.url AND n.target = ''),
edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM named a JOIN nodes b ON b.url = a.url AND b.target <> '' WHERE a.node <> b.node),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
    SELECT a AS node, a AS other FROM both_ways
    UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
places AS (
    SELECT DISTINCT other AS node, regexp_extract(other, '^[^/?#]*') AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
ruled AS (
    SELECT DISTINCT host, path, first(rh || rp ORDER BY length(rh || rp) DESC, rh || rp) AS rule,
           first(rv ORDER BY length(rh || rp) DESC, rh || rp, rv) AS rv
    FROM (SELECT host, path FROM places UNION SELECT host, path FROM urls WHERE host <> '') p
    JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
    GROUP BY host, path),
shared AS (
    SELECT r.node, min(d.rv) AS rv FROM reach r JOIN places p ON p.node = r.other
    JOIN ruled d ON d.host = p.host AND d.path = p.path GROUP BY r.node)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.rv, s.rv, 'allow') AS verdict
FROM named u LEFT JOIN ruled r ON r.host = u.host AND r.path = u.path LEFT JOIN shared s ON s.node = u.node
""")


@query
def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_texts(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", "n_chars")


@query
def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "p_bad", "p_toxic", "rejected", (~F.col("rejected")).alias("kept"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_tagger(docs), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base_spans", lambda s: s["kind"] == F.lit(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_loops(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs, min_words=24, min_exponent=3, keep=["doc_id"])
    # Runs come by start, then period, so the first of those with the greatest exponent stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(with_shared_heads(sequences(turns), group=5, most=8))


# crc32 bit by bit: the byte is mixed in, then eight times the register moves right and the polynomial is mixed in.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
ORACLE["op12_prefix_trie"] = """
WITH own AS (
    SELECT conv_id, list(struct_pack(k := concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')),
                                     n := strlen(coalesce(text, ''))) ORDER BY turn NULLS FIRST, role, text) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, t, """ + _CRC32.format("CAST(conv_id AS VARCHAR)") + """ % 9 AS h FROM own),
rebuilt AS (
    SELECT a.conv_id, coalesce(b.t[1:a.h], []) || a.t[a.h + 1:] AS t
    FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
digests AS (SELECT conv_id, list_transform(t, lambda x: sha256(x.k)) AS k, list_transform(t, lambda x: x.n) AS n FROM rebuilt),
members AS (
    SELECT conv_id, len(k) AS turns, d, array_to_string(k[1:d], ',') AS prefix, array_to_string(k[1:d - 1], ',') AS above, n[d] AS bytes
    FROM (SELECT *, unnest(generate_series(0, len(k))) AS d FROM digests)),
nodes AS (
    SELECT d, prefix, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
           CASE WHEN d > 0 THEN (count(*) - 1) * min(bytes) ELSE 0 END AS saved, max(turns) = d AS childless,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = d), '')) AS ends_sha256
    FROM members GROUP BY d, prefix),
children AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (
    SELECT m.d, m.prefix, count(*) FILTER (WHERE n.childless) AS n_leaves, sum(n.saved) AS saved
    FROM members m JOIN (SELECT x.conv_id, y.d, y.prefix, y.saved, y.childless FROM members x
                         JOIN nodes y ON y.conv_id = x.conv_id AND y.d = x.d AND y.prefix = x.prefix) n
      ON n.conv_id = m.conv_id AND n.d >= m.d
    GROUP BY m.d, m.prefix)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.prefix = n.prefix
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = n.above
LEFT JOIN children c ON c.d = n.d AND c.prefix = n.prefix
"""


@query
def op13_adaptive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


ORACLE["op13_adaptive_join"] = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[ 	-
]+'), lambda w: w <> '') AS w
    FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS p FROM cut)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT c.doc_id, coalesce(max(s.n), 0) AS n_shingles, coalesce(min(r.other), c.doc_id) AS component_id
FROM cut c LEFT JOIN sizes s ON s.doc_id = c.doc_id LEFT JOIN reach r ON r.doc_id = c.doc_id GROUP BY c.doc_id
"""
