"""What a task holds stays as it is when tables grow."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import blocks, history, media, parts
from fleetlens.queries import QUERIES


def test_records_are_spread(spark, tmp_path):
    spark.range(25_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["redact_nested"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 3
    assert got.agg(F.count_distinct("id"), F.min(F.col("record").contains("[REDACTED]"))).first()[:] == (25_000, True)
    spark.range(0).select(F.col("id").alias("c_custkey"), F.lit("").alias("c_name")).write.parquet(f"{tmp_path}/none/customer.parquet")
    assert QUERIES["redact_nested"](spark, f"{tmp_path}/none").count() == 0


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(parts, "ROWS", 5)


def test_blocks_are_dealt_by_their_number(spark, small_tasks):
    docs = [(i, "<!-- wp:a --><!-- /wp:b --><!-- wp:c -->") for i in range(30)] + [(None, "<!-- /wp:a -->")]
    got = blocks.block_errors(spark.createDataFrame(docs, "doc int, markup string"), "doc")
    assert got.rdd.getNumPartitions() > 8
    want = [(i, *x) for i in range(30) for x in ((1, "mismatched_closer", "core/b", "core/a"), (2, "unclosed_block", "core/c", None))]
    assert sorted((tuple(r) for r in got.collect() if r.doc is not None), key=str) == sorted(want, key=str)
    assert [tuple(r) for r in got.where("doc IS NULL").collect()] == [(None, 0, "unbalanced_closer", "core/a", None)]


def test_cascade_is_dealt_by_its_rows(spark, monkeypatch):
    files = media.visible_files(spark.createDataFrame([(f"a/{'F' if i % 2 else 'f'}{i}.jpg", 1) for i in range(40)] + [("b/f0.jpg", 1)], "path string, size long"))
    refs = spark.createDataFrame([(f"{'a' if i % 3 else 'c'}/f{i}.jpg",) for i in range(60)], "path string")
    whole = {tuple(r) for r in media.cascade(refs, files).collect()}
    monkeypatch.setattr(media, "PATHS", 5)
    got = media.cascade(refs, files)
    assert got.rdd.getNumPartitions() > 8
    assert {tuple(r) for r in got.collect()} == whole and {r[2] for r in whole} == {"exact", "case", "name", "missing"}


def plain_fired(data, window):
    out = set()
    for key in {k for k, _ in data}:
        last = None
        for ts in sorted({t for k, t in data if k == key}):
            if last is None or ts - last >= window:
                out.add((key, ts))
                last = ts
    return out


def test_alerts_are_walked_in_one_pass(spark, monkeypatch):
    rng = random.Random(5)
    data = [(f"k{min(rng.randint(0, 30), 9)}", rng.randint(0, 3000)) for _ in range(900)]
    df = spark.createDataFrame(data, "key string, ts bigint")
    assert {tuple(r) for r in history.fired_instants(df, 37, walk=50).collect()} == plain_fired(data, 37)
    # Rounds over all alerts are for keys that are too long for a task.
    monkeypatch.setattr(history, "_double", None)
    assert {tuple(r) for r in history.fired_instants(df, 37).collect()} == plain_fired(data, 37)
    assert history.fired_instants(df.limit(0), 37).count() == 0
    odd = spark.createDataFrame([("a", None), ("a", 5), ("b", None), (None, 7), (None, 90)], "key string, ts bigint")
    assert sorted(((r.key, r.ts) for r in history.fired_instants(odd, 37).collect()), key=str) == [("a", 5), ("b", None), (None, 7)]
