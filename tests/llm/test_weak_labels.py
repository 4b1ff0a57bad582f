"""The drawn sample, the label model and the scorer against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import weak_labels


def test_copies_are_drawn_once(spark):
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(
        F.concat(F.lit("text "), "id")).alias("text"))
    for labels in (None, rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))):
        got = weak_labels.drawn(rows, labels, 8000).collect()
        assert len(got) <= 16_000 and len({r.text for r in got}) == len(got)
        assert sum(r.copies for r in got) >= 2000


def test_posterior_is_bayes():
    model = weak_labels.LabelModel(3)
    model.rates, model.prior = np.array([[0.1, 0.2, 0.3], [0.6, 0.7, 0.9]]), 0.25
    for pattern in ("bbb", "g-b", "---", "ggg"):
        both = [1 - model.prior, model.prior]
        for k in (0, 1):
            for vote, rate in zip(pattern, model.rates[k]):
                both[k] *= {"b": rate, "g": 1 - rate, "-": 1}[vote]
        assert abs(model.posterior([pattern])[0] - both[1] / sum(both)) < 1e-12


def test_scorer_is_a_logistic_fit():
    draw = random.Random(3)
    docs = [[k for k in range(6) if draw.random() < 0.4] for _ in range(60)]
    target = np.array([0.9 if 2 in d else 0.1 for d in docs])
    weight = np.array([draw.choice([1.0, 3.0]) for _ in docs])
    row, column = (np.array(x) for x in zip(*[(i, k) for i, d in enumerate(docs) for k in d]))
    got = weak_labels.Scorer().fit(np.arange(6), row, column, target, weight, rounds=40)

    mean = weight.sum() / len(docs)
    share = sum(w / mean * t for w, t in zip(weight, target)) / len(docs)
    w, bias, past = [0.0] * 6, math.log(share / (1 - share)), [0.0] * 6
    for _ in range(40):
        error = [x / mean * (1 / (1 + math.exp(-(bias + sum(w[k] for k in d)))) - t) for x, d, t in zip(weight, docs, target)]
        for k in range(6):
            slope = sum(e for e, d in zip(error, docs) if k in d) / len(docs)
            past[k] += slope ** 2
            rate = 0.5 / math.sqrt(past[k] + 1e-12)
            w[k] -= rate * slope
            w[k] = math.copysign(max(abs(w[k]) - rate * 1e-4, 0), w[k])
        bias -= sum(error) / len(docs)
    assert np.allclose([got.table().get(k, 0.0) for k in range(6)], w) and abs(got.bias - bias) < 1e-9


def test_capitals_in_any_script():
    for body in ("", "abc", "ABC def", "ÄÖü straße ΑΒγ 日本 Ǆ", "1 2 !"):
        want = sum(map(str.isupper, body)) / max(sum(map(str.isalpha, body)), 1)
        assert weak_labels.capitals(body, body.encode()) == want


def test_workers_hold_one_operators_memory(spark):
    from fleetlens.llm import common
    from pyspark.sql.types import LongType, StructField

    def built(name):
        def make():
            own = common.held(name, 1, lambda: [0]) if name else [0]

            def run(batch):
                own[0] += 1
                return [[own[0] + 1000 * len(common.HELD)] * batch.num_rows]
            return run
        return common.extend(spark.range(1).coalesce(1), [StructField("n", LongType())], make, holds=name).first()["n"]

    spark.range(8).repartition(8).mapInArrow(lambda b: b, "id long").count()
    seen = [built("a") // 1000, built(None) // 1000, built("b") // 1000]
    assert seen == [1, 0, 1]


def test_an_encoder_goes_as_soon_as_it_is_let_go():
    import gc
    import weakref

    from fleetlens.llm import bpe, common

    table = b"YQ== 0\nYg== 1\nYWI= 2\n"
    gc.disable()
    try:
        own = common.held(bpe.HOLDS, (table, "."), lambda: bpe.Codec(table, r"\S+"))
        assert own.encode("ab ab ab b").tolist() == [2, 2, 2, 1] and own.decode(np.array([2, 1])) == b"abb"
        memo = weakref.ref(own.memo)
        del own, common.HELD[bpe.HOLDS]
        assert memo() is None
    finally:
        gc.enable()
