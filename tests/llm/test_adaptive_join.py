"""Components of the n-gram Jaccard join against all pairs compared."""

import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import adaptive_join
from fleetlens.llm.adaptive_join import block_links, most, needed, ngram_components
from fleetlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain_set(text, words):
    parts = (text or "").encode().lower().split()
    size = min(words, len(parts))
    return {tuple(parts[i:i + size]) for i in range(len(parts) - size + 1)} if parts else set()


def plain_components(rows, words, percent):
    """A row per input row; rows of one doc_id are sets of their own, named by it."""
    sets = [plain_set(t, words) for _, t in rows]
    ids = [float("-inf") if d is None else d for d, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    plain = lambda d: None if d == float("-inf") else d
    return sorted((str(d), len(s), str(plain(least[find(i)]))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(spark, rows, words, percent):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_components(df, words, percent).collect())


def edited(draw, words, edits):
    words = words[:]
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.random()}"
    return words


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 3)])
def test_families_near_the_limit(spark, monkeypatch, seed, block):
    monkeypatch.setattr(adaptive_join, "BLOCK", block)
    draw = random.Random(seed)
    texts = []
    for size in (7, 9, 20, 60, 150):
        base = [f"w{draw.randrange(3000)}" for _ in range(size)]
        texts.append(base)
        for _ in range(25):
            texts.append(edited(draw, draw.choice(texts[-6:]) if draw.random() < 0.5 else base, draw.randint(0, 1 + size // 40)))
    passage = [f"p{i}" for i in range(12)]
    texts += [[f"u{draw.random()}" for _ in range(draw.randint(1, 30))] + passage for _ in range(30)]  # a passage that many share
    slots = [[f"s{i}v{k}" for k in range(3)] for i in range(20)]
    texts += [[w for s in slots for w in (draw.choice(s), "and", "then", "so")] for _ in range(40)]  # form letters
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    assert found(spark, rows, 4, 85) == plain_components(rows, 4, 85)


def test_undefined_rows_and_copies(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, a), (4, a.upper()), (4, None), (9, ""), (8, " \t"), (3, "one two"), (2, "One  two"), (7, "three"), (None, a), (None, "lost row"),
            (7, a + " again"), (6, "three"), (11, "a b c d e"), (11, "a b c d e"), (12, "x " * 3000), (13, "x")]
    rows = [(d, t) for d, t in rows]
    assert found(spark, rows, 4, 85) == plain_components(rows, 4, 85)
    assert found(spark, rows, 1, 100) == plain_components(rows, 1, 100)
    assert found(spark, rows[:0], 4, 85) == []


def test_very_long_texts(spark):
    draw = random.Random(4)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join(edited(draw, base, 1200))), (3, " ".join(edited(draw, base, 9000)))]
    assert found(spark, rows, 4, 85) == plain_components(rows, 4, 85)


def test_prefixes_share_what_is_asked():
    draw = np.random.default_rng(7)
    for _ in range(4000):
        n, percent = int(draw.integers(6, 80)), int(draw.choice([70, 85, 90]))
        x = draw.choice(4000, n, replace=False)
        keep = draw.integers(n // 2, n + 1)
        y = np.union1d(x[:keep], draw.choice(4000, draw.integers(0, n // 3 + 1), replace=False))
        x, both = np.sort(x), len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        lx, ly = (int(draw.integers(1, most(len(s)) + 3)) for s in (x, y))
        heads = [s[:len(s) - needed(len(s), percent) + l] for s, l in ((x, lx), (y, ly))]
        assert len(np.intersect1d(*heads)) >= min(lx, ly, both)


def test_block_gives_one_link_for_two_components():
    tokens = np.arange(100)
    row = lambda i, c, gone: (i, 2, c, np.delete(tokens, gone))
    got = block_links([row(1, 1, [90]), row(2, 2, [91])], [row(3, 3, [92]), row(4, 3, [93]), row(5, 5, list(range(50, 90)))], 85)
    assert got == [(1, 3), (2, 3)]


def test_query_matches_sql(spark):
    ok, note = oracle.compare(spark, oracle.connect(SF), QUERIES["op13_adaptive_join"], ORACLE["op13_adaptive_join"], SF)
    assert ok, note


def test_a_staged_table_leaves_no_shuffle_files(spark):
    import time

    from fleetlens.session import staged

    def shuffles():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    staged(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).count(), "s")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before


def test_texts_of_one_id_and_repeated_rows_have_a_set_each(spark):
    draw = random.Random(4)
    base = [" ".join(draw.choices("abcdefghij", k=40)) for _ in range(6)]
    rows = [(k % 2 or None, t) for k, t in enumerate(base)] * 3 + [(9, base[0]), (8, base[1] + " z"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = adaptive_join.texts(docs, "text").where("text <> ''").select(F.xxhash64("doc", "h").alias("id"), "doc", "h").distinct()
    sets = adaptive_join.token_sets(docs, nodes, 4).collect()
    assert len(sets) == len({r.id for r in sets}) == nodes.count() == 8
    assert sorted(len(r.tokens) for r in sets) == sorted(len(plain_set(t, 4)) for t in [*base, base[0], base[1] + " z"])


@pytest.fixture
def dealt(monkeypatch):
    """Per call, the (documents, tokens) that are dealt to pairs of blocks."""
    seen, real = [], adaptive_join.map_rows

    def spy(df, *rest):
        seen.append(tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()))
        return real(df, *rest)

    monkeypatch.setattr(adaptive_join, "map_rows", spy)
    return seen


def test_a_shared_passage_deals_no_set(spark, monkeypatch, dealt):
    monkeypatch.setattr(adaptive_join, "BLOCK", 4)
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"u{draw.random()}" for _ in range(draw.randint(40, 60))] for _ in range(40)]
    texts += [edited(draw, texts[0], 1), edited(draw, texts[3], 2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(spark, rows, 4, 85) == plain_components(rows, 4, 85)
    assert sum(n for n, _ in dealt) <= 4  # at most the linked ones, not each of 40 once for each block of 4


def test_pairs_of_blocks_are_dealt_in_rounds(spark, monkeypatch, dealt):
    monkeypatch.setattr(adaptive_join, "BLOCK", 3)
    draw = random.Random(6)
    slots = [[f"s{i}v{k}" for k in range(3)] for i in range(20)]
    rows = [(i, " ".join(w for s in slots for w in (draw.choice(s), "and", "then", "so"))) for i in range(60)]
    assert found(spark, rows, 4, 85) == plain_components(rows, 4, 85)
    sets = sum(len(plain_set(t, 4)) for _, t in rows)
    assert len(dealt) > 4 and sum(t for _, t in dealt) > 4 * sets
    assert max(t for _, t in dealt) <= 2 * sets


def test_linked_sets_stay_and_share_a_rarest_token(spark):
    draw = random.Random(7)
    common = list(range(-30, 30))  # of many documents
    sets = []
    for k in range(30):
        base = draw.sample(common, draw.randint(0, 60)) + [1000 * k + i for i in range(draw.randint(8, 60))]
        sets += [base] + [[t for t in base if draw.random() > 0.05] + [10 ** 6 * (k + 1) + i for i in range(draw.randint(0, 3))] for _ in range(4)]
    lone = [list(range(-30, 30)) + list(range(10 ** 9 + 100 * k, 10 ** 9 + 100 * k + 11)) for k in range(3)]  # 11 of 71 are their own
    sets += lone
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, tokens array<bigint>")
    kept = {r.id for r in adaptive_join.partnered(df, 85).collect()}
    rare = {}
    for r in adaptive_join.rarest(df, 85).collect():
        rare.setdefault(r.id, set()).add(r.token)
    linked = 0
    for i, x in enumerate(map(set, sets)):
        for j in range(i):
            y = set(sets[j])
            if 100 * len(x & y) >= 85 * len(x | y):
                linked += 1
                assert {i, j} <= kept and rare[i] & rare[j]
    assert linked > 100
    assert not kept & set(range(len(sets) - 3, len(sets)))


def test_tables_go_when_nothing_reads_them_any_more(spark, monkeypatch):
    import os

    made, real = [], adaptive_join.staged
    monkeypatch.setattr(adaptive_join, "staged", lambda df, label="stage": made.append(real(df, label)) or made[-1])
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(20)]
    assert found(spark, rows, 4, 85) == plain_components(rows, 4, 85)
    left = [t for t in made if os.path.exists(t.staged_path)]
    assert len(made) > 20 and not [t.staged_path for t in left if {"head", "tokens", "token"} & set(t.columns)]
