"""The prefix trie against one built prefix by prefix, over one range and over many."""

import hashlib
import random
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from fleetlens.llm.prefix_trie import prefix_trie, sequences, with_shared_heads
from fleetlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(convs):
    """{(conv_id, depth): the other columns} from {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for prefix, ids in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        ends = sorted(c for c in ids if len(convs[c]) == len(prefix))
        out[min(ids), len(prefix)] = (
            min(members[prefix[:-1]]) if prefix else None, len(ids), sum(len(p) == len(prefix) + 1 for p in below),
            sum(not any(q[:len(p)] == p and len(q) > len(p) for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def plain_heads(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, convs):
    return spark.createDataFrame([(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)], SCHEMA)


@pytest.fixture(params=["one range", "many ranges"])
def ranges(spark, request):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "1" if request.param == "one range" else "13")):
        spark.conf.set(n, v)
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, ranges, seed):
    draw = random.Random(seed)
    convs, turns = {}, [("user", "héllo"), ("bot", "a"), ("", "")]
    for c in draw.sample(range(-3, 400), 90):
        old = draw.choice(list(convs.values())) if convs and draw.random() < 0.7 else []
        convs[c] = old[:draw.randint(0, 6)] + [draw.choice(turns) for _ in range(draw.choice([0, 0, 1, 2, 4]))]
    convs.update({c: [turns[0]] * 3 for c in range(1000, 1040)})  # copies that fill ranges
    named = {c: t for c, t in convs.items() if t}
    assert found(prefix_trie(sequences(table(spark, named)))) == plain_trie(named)
    if seed < 2:
        lent = {c: t for c, t in named.items() if c >= 0}
        assert found(prefix_trie(with_shared_heads(sequences(table(spark, lent))))) == plain_trie(plain_heads(lent))


def test_turnless_conversations_and_long_ones(spark, ranges):
    rows = spark.createDataFrame([(k, [{"digest": b"%016d" % i, "bytes": i} for i in range(n)]) for k, n in ((1, 0), (2, 0), (3, 600), (4, 601))],
                                 "conv_id bigint, turns array<struct<digest: binary, bytes: bigint>>")
    got = found(prefix_trie(rows))
    assert len(got) == 602
    assert got[1, 0] == (None, 4, 1, 1, sum(range(600)), hashlib.sha256(b"1,2").hexdigest())
    assert got[3, 1][:4] == (1, 2, 1, 1) and got[4, 601][:4] == (3, 1, 0, 1)


def test_nulls_ties_and_other_columns(spark, ranges):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "bot", "y"), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"turns": F.lit(1), "key": F.lit("k"), "Depth": F.lit(2)})
    convs = {1: [("", ""), ("bot", "y"), ("user", "x"), ("user", "x")], 2: [("", "")]}
    assert found(prefix_trie(sequences(df))) == plain_trie(convs)
    assert found(prefix_trie(sequences(df.limit(0)))) == {}


def test_query_matches_sql(spark, ranges):
    ok, note = oracle.compare(spark, oracle.connect(SF), QUERIES["op12_prefix_trie"], ORACLE["op12_prefix_trie"], SF)
    assert ok, note
