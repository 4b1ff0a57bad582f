"""Quality and toxicity from weak labels: heuristic labellers, label models, and a hashed linear scorer.

Labellers vote on every document, in families of overlapping ones for each kind of
defect. Expectation-maximisation over the counted vote patterns finds how far each
can be trusted, which turns votes into posterior labels; hand labels, where there
are any, are one labeller more. A linear scorer over hashed features learns from
the posterior labels of a bounded sample and judges all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField

from fleetlens.llm.common import extend, map_rows, quoted
from fleetlens.session import staged

#: Most documents that the scorer is fitted on (drawn by a hash of their row).
SAMPLE_ROWS = 8000
#: How far a hand label is trusted, and the most that the heuristics together may weigh against it.
HAND, SURE = 0.98, 0.95
#: How many documents without a hand label one with it counts for when a scorer is fitted to abuse.
HAND_WEIGHT = 10.0
#: Standard errors by which a feature's share of bad documents must differ from the mean for it to get a weight.
MIN_LIFT = 4.0
#: A vote needs at least so many words; with fewer the labeller abstains.
MIN_WORDS = 8
#: Bytes of a text compressed at a time.
PIECE = 1 << 16

# Frequent function words of English, German, French and Spanish, and terms of abuse.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it with as was be by on not this are or at from have an they which had he but "
    "der die das und in zu den von mit sich auf für ist im dem nicht ein eine als auch es an er so "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se "
    "el los las y del se por con no su para es al lo como más o".split())
INSULTS = (
    frozenset("idiot idiots moron morons stupid dumb imbecile fool cretin dimwit halfwit clown clowns".split()),
    frozenset("loser losers worthless pathetic useless failure nobody reject parasite leech".split()),
    frozenset("trash scum filth vermin garbage disgusting vile rat pig swine".split()),
)
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-")
NOT_MARKS = bytes(b for b in range(256) if b not in MARKS)
ASCII_UPPER, ASCII_LOWER = (bytes(range(ord(a), ord(a) + 26)) for a in "Aa")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
EDGES = ".,;:!?'\"()[]{}<>*#$%&|+-_/\\=~^@`…»«“”‘’"


def squeezed(data: bytes) -> float:
    """The compressed share of all of `data`, which is fed in pieces."""
    packer = zlib.compressobj(1)
    size = sum(len(packer.compress(data[at:at + PIECE])) for at in range(0, len(data), PIECE)) + len(packer.flush())
    return size / max(len(data), 1)


def capitals(body: str, data: bytes) -> float:
    """The share of upper-case letters among all letters; `data` is `body` in UTF-8."""
    upper = len(data) - len(data.translate(None, ASCII_UPPER))
    letters = upper + len(data) - len(data.translate(None, ASCII_LOWER))
    if len(data) != len(body):
        others = BEYOND_ASCII.findall(body)
        upper += sum(map(str.isupper, others))
        letters += sum(map(str.isalpha, others))
    return upper / max(letters, 1)


def measures(text: str | None) -> tuple[list[str], dict[str, float]]:
    """The words of a text (lower case, edge punctuation off) and what the labellers and the scorer look at."""
    body = text or ""
    data = body.encode()
    tokens = body.split()
    n = max(len(tokens), 1)
    words = [t.strip(EDGES) for t in body.lower().split()]
    counts = Counter(words)
    marks = len(data.translate(None, NOT_MARKS))
    full = [w for w in words if w]
    top = max((c for w, c in counts.items() if w and w not in FUNCTION_WORDS), default=0)
    return words, {
        "n": len(tokens),
        "marks": marks / max(len(body), 1),
        "bare": 1 - len(full) / n,
        "decorated": sum(1 for t in tokens if t[-1] in "*#$%&|+=~^@_<>\\") / n,
        "stutter": sum(map(eq, full, full[1:])) / n,
        "top": top / n,
        "function": sum(c for w, c in counts.items() if w in FUNCTION_WORDS) / n,
        "stops": sum(body.count(c) for c in ".!?") / n,
        "fresh": len(counts) / n,
        "upper": sum(map(str.isupper, tokens)) / n,
        "capitals": capitals(body, data),
        "shouts": body.count("!") / n,
        "squeeze": squeezed(data),
        **{f"insults{i}": sum(counts[w] for w in some if w in counts) for i, some in enumerate(INSULTS)},
    }


# Families of labellers, one per kind of defect. A vote is 'b' (bad), 'g' (good) or '-' (too few words to tell).
FAMILIES = {
    "clutter": (lambda m: m["marks"] > 0.05, lambda m: m["decorated"] > 0.25, lambda m: m["marks"] * m["n"] > 0.3 * m["n"] or m["bare"] > 0.2),
    "stutter": (lambda m: m["stutter"] > 0.15, lambda m: m["squeeze"] < 0.12, lambda m: m["fresh"] < 0.1),
    "shouting": (lambda m: m["upper"] > 0.4, lambda m: m["shouts"] > 0.3, lambda m: m["capitals"] > 0.5),
    "listing": (lambda m: m["bare"] > 0.2, lambda m: m["function"] < 0.05, lambda m: m["stops"] < 0.01),
    "abuse": tuple((lambda m, i=i: m[f"insults{i}"] > 0) for i in range(len(INSULTS)))
             + (lambda m: sum(m[f"insults{i}"] for i in range(len(INSULTS))) >= 2,),
}
QUALITY = ("clutter", "stutter", "shouting", "listing")


def votes(m: dict[str, float]) -> list[str]:
    """One pattern per family."""
    short = m["n"] < MIN_WORDS
    return ["".join("-" if short and family != "abuse" else "b" if test(m) else "g" for test in tests)
            for family, tests in FAMILIES.items()]


class LabelModel:
    """Two classes and conditionally independent labellers, each with its own rates of 'bad' votes in either class.

    `fit` sees counted patterns only: there are at most 3**k for k labellers,
    however many documents voted. The classes keep their sense because every
    labeller starts out better than chance; the share of bad documents is learned.
    """

    def __init__(self, labellers: int, rounds: int = 200) -> None:
        self.rates = np.tile([[0.05], [0.5]], (1, labellers))  # class x labeller: P(votes bad | class, votes at all)
        self.prior, self.rounds = 0.15, rounds

    def posterior(self, patterns: list[str]) -> np.ndarray:
        if not patterns:
            return np.empty(0)
        said = np.array([[1.0 if v == "b" else 0.0 for v in p] for p in patterns])
        spoke = np.array([[0.0 if v == "-" else 1.0 for v in p] for p in patterns])
        log = np.log([1 - self.prior, self.prior])[None, :] + (
            (said * spoke) @ np.log(self.rates).T + ((1 - said) * spoke) @ np.log(1 - self.rates).T)
        log -= log.max(axis=1, keepdims=True)
        return (p := np.exp(log))[:, 1] / p.sum(axis=1)

    def fit(self, counted: dict[str, int]) -> LabelModel:
        patterns, weight = list(counted), np.array(list(counted.values()), dtype=float)
        if not patterns:
            return self
        said = np.array([[1.0 if v == "b" else 0.0 for v in p] for p in patterns])
        spoke = np.array([[0.0 if v == "-" else 1.0 for v in p] for p in patterns])
        for _ in range(self.rounds):
            bad = self.posterior(patterns)
            before = self.rates.copy()
            for k, share in ((0, (1 - bad) * weight), (1, bad * weight)):
                self.rates[k] = ((share @ (said * spoke)) + 1) / ((share @ spoke) + 2)
            # A labeller worse than chance would turn the classes round.
            self.rates[0] = np.minimum(self.rates[0], self.rates.mean(axis=0))
            self.prior = float(np.clip((bad * weight).sum() / weight.sum(), 0.001, 0.5))
            if np.abs(self.rates - before).max() < 1e-6:
                break
        return self


def _hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) >> 16


@lru_cache(maxsize=50_000)
def _word_hashes(word: str) -> tuple[int, ...]:
    return tuple(_hash(x) for x in (word, f"\x01{word[:4]}", f"\x02{word[:6]}"))


MEASURES = ("marks", "bare", "decorated", "stutter", "top", "function", "stops", "squeeze", "fresh", "upper", "capitals", "shouts")
STEPS = {k: [_hash(f"\x00{k}:{s}") for s in range(21)] for k in MEASURES}
LENGTHS = [_hash(f"\x00n:{bits}") for bits in range(40)]
#: Told apart from a beginning's own hash: it begins two, or four or more, distinct words.
TWO, FOUR = 0x5555, 0xAAAA


def _measure_hashes(m: dict[str, float]) -> list[int]:
    out = [LENGTHS[min(39, int(m["n"]).bit_length())]]
    for k in MEASURES:
        out += STEPS[k][:min(20, int(m[k] * 40)) + 1]
    return out


def _start_hashes(starts: Counter) -> list[int]:
    out = []
    for begin, k in starts.items():
        out.append(begin)
        if k > 1:
            out.append(begin ^ TWO)
        if k > 3:
            out.append(begin ^ FOUR)
    return out


def features(words: list[str], m: dict[str, float]) -> np.ndarray:
    """Hashed features, each present or not.

    The distinct words; their beginnings of four and six letters, with how many
    distinct words share one (1, 2, 4 or more); the measures in steps.
    """
    names = set(words)
    names.discard("")
    hashes: list[int] = []
    starts: Counter = Counter()
    for word in names:
        whole, *begins = _word_hashes(word)
        hashes.append(whole)
        starts.update(begins)
    return np.array(hashes + _start_hashes(starts) + _measure_hashes(m), dtype=np.int64)


class Weighty(dict):
    """For each word asked for, its features that have a weight: (hash of the word or 0, hashes of its beginnings)."""

    LIMIT = 300_000

    def __init__(self, weighted: set[int]) -> None:
        super().__init__()
        self.weighted = weighted

    def __missing__(self, word: str) -> tuple[int, list[int]] | None:
        whole, *begins = (_hash(x) for x in (word, f"\x01{word[:4]}", f"\x02{word[:6]}"))
        begins = [b for b in begins if not self.weighted.isdisjoint((b, b ^ TWO, b ^ FOUR))]
        found = (whole if whole in self.weighted else 0, begins)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = found if found[0] or begins else None
        return found

    def of(self, words: list[str], m: dict[str, float]) -> list[int]:
        """`features`, without most of those that have no weight."""
        names = set(words)
        names.discard("")
        hashes, starts = [], Counter()
        for whole, begins in filter(None, map(self.__getitem__, names)):
            if whole:
                hashes.append(whole)
            starts.update(begins)
        return hashes + _start_hashes(starts) + _measure_hashes(m)


class Scorer:
    """A logistic model over hashed features with an L1 penalty; only features with a weight are kept."""

    def __init__(self) -> None:
        self.hashes, self.weights, self.bias = np.empty(0, np.int64), np.empty(0), -20.0

    def fit(self, hashes: np.ndarray, row: np.ndarray, column: np.ndarray, target: np.ndarray, weight: np.ndarray,
            penalty: float = 1e-4, rounds: int = 250) -> Scorer:
        """Document row[i] has feature hashes[column[i]]; `target` is P(bad) and `weight` how much a document counts."""
        if not len(target):
            return self
        n, width, weight = len(target), len(hashes), weight / weight.mean()
        mean = float(np.clip((weight * target).mean(), 1e-3, 1 - 1e-3))
        w, bias, past = np.zeros(width), float(np.log(mean / (1 - mean))), np.zeros(width)
        for _ in range(rounds):
            z = np.bincount(row, w[column], minlength=n) + bias
            error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            slope = np.bincount(column, error[row], minlength=width) / n
            past = past + slope ** 2
            rate = 0.5 / np.sqrt(past + 1e-12)
            w = w - rate * slope
            w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
            bias -= error.mean()
        used = w != 0
        self.hashes, self.weights, self.bias = hashes[used], w[used], bias
        return self

    def table(self) -> dict[int, float]:
        return dict(zip(self.hashes.tolist(), self.weights.tolist(), strict=True))


def combined(models: dict[str, LabelModel], patterns: list[list[str]], hand: np.ndarray, families: tuple[str, ...]) -> np.ndarray:
    """P(bad) per document: any of the families finds a defect, and what a hand label (1, 0 or nan) adds."""
    fine = np.ones(len(patterns))
    for family in families:
        at = list(FAMILIES).index(family)
        distinct = sorted({p[at] for p in patterns})
        value = dict(zip(distinct, models[family].posterior(distinct), strict=True))
        fine *= 1 - np.array([value[p[at]] for p in patterns])
    p = np.clip(1 - fine, 1 - SURE, SURE)
    odds = p / (1 - p) * np.where(hand == 1, HAND / (1 - HAND), np.where(hand == 0, (1 - HAND) / HAND, 1.0))
    return odds / (1 + odds)


def label_models(docs: DataFrame, text: str = "text") -> dict[str, LabelModel]:
    """A fitted label model per family, from the vote patterns of all documents, counted within tasks first."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column("text"):
                counts.update(zip(FAMILIES, votes(measures(value.as_py())[1]), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], ["family", "pattern", "n"])

    fields = [StructField("family", StringType()), StructField("pattern", StringType()), StructField("n", LongType())]
    rows = map_rows(docs.select(quoted(text).alias("text")), run, fields).groupBy("family", "pattern").agg(F.sum("n").alias("n")).collect()
    return {family: LabelModel(len(tests)).fit({r.pattern: r.n for r in rows if r.family == family})
            for family, tests in FAMILIES.items()}


def drawn(docs: DataFrame, labels: DataFrame | None, rows: int, text: str = "text") -> DataFrame:
    """(text, hand_bad, hand_toxic, copies) of about `rows` documents drawn by a hash: labelled ones first, then others.

    Equal texts with equal labels are one row that counts for its copies, so a text that
    owns half of the table is drawn once or not at all.
    """
    part = lambda value, n, total: F.pmod(F.xxhash64(F.lit(7), value), F.lit(2 ** 20)) < int(2 ** 20 * min(1.0, n / max(total, 1)))
    body = docs.select(quoted("doc_id").alias("doc_id"), quoted(text).alias("text"))
    hand = ["hand_bad", "hand_toxic"]
    none = [F.lit(None).cast("double").alias(c) for c in hand]
    if labels is None:
        out = body.where(part(F.col("text"), rows, docs.count())).select("text", *none)
        return out.groupBy("text", *hand).agg(F.count("*").alias("copies"))
    once = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = once.count()
    # About `rows` labels at most, so they are broadcast and the documents need no shuffle.
    some = F.broadcast(once.where(part(F.col("doc_id"), rows, known)))
    out = body.join(some, "doc_id").select("text", (1 - F.col("quality")).cast("double").alias("hand_bad"),
                                           F.col("toxic").cast("double").alias("hand_toxic"))
    if known < rows:
        out = out.union(body.join(some, "doc_id", "left_anti").where(part(F.col("text"), rows - known, docs.count())).select("text", *none))
    return out.groupBy("text", *hand).agg(F.count("*").alias("copies"))


#: For each scorer its columns: posterior label and weight of a document.
TARGETS = (("bad", "bad_weight"), ("toxic", "toxic_weight"))


def learned_from(docs: DataFrame, labels: DataFrame | None, models: dict[str, LabelModel], text: str, sample_rows: int) -> DataFrame:
    """(f, copies, bad, toxic, bad_weight, toxic_weight) per drawn text: features, posterior labels, and what the document counts for."""
    fields = [StructField("f", ArrayType(LongType())), StructField("bad", DoubleType()), StructField("toxic", DoubleType())]

    def make():
        def run(batch: pa.RecordBatch) -> list:
            out = [measures(v.as_py()) for v in batch.column("text")]
            patterns = [votes(m) for _, m in out]
            hand = [np.array([np.nan if x is None else x for x in batch.column(c).to_pylist()], dtype=float) for c in ("hand_bad", "hand_toxic")]
            return [[features(w, m) for w, m in out], combined(models, patterns, hand[0], QUALITY).tolist(),
                    combined(models, patterns, hand[1], ("abuse",)).tolist()]

        return run

    found = extend(drawn(docs, labels, sample_rows, text), fields, make, ["hand_toxic", "copies"])
    heft = F.when(F.col("hand_toxic").isNull(), 1.0).otherwise(HAND_WEIGHT)
    return found.select("f", "copies", "bad", "toxic", F.col("copies").cast("double").alias("bad_weight"),
                        (F.col("copies") * heft).alias("toxic_weight"))


def telling(sample: DataFrame) -> list[np.ndarray]:
    """For each scorer the sorted features that at least three documents have and whose company is better or worse than chance.

    Counted by Spark; the driver gets the features that are left, at most those of the sample.
    """
    totals = sample.agg(*[x for p, w in TARGETS for x in (F.sum(F.col(w) * F.col(p)).alias(p), F.sum(w).alias(w))]).first()
    counts = sample.select("copies", *[c for t in TARGETS for c in t], F.explode("f").alias("f")).groupBy("f").agg(
        F.sum("copies").alias("n"), *[x for p, w in TARGETS for x in (
            F.sum(F.col(w) * F.col(p)).alias(f"{p}_hits"), F.sum(w).alias(f"{p}_all"), F.sum(F.col(w) ** 2 / F.col("copies")).alias(f"{p}_squares"))])
    lifted = []
    for p, w in TARGETS:
        mean = min(max((totals[p] or 0.0) / (totals[w] or 1.0), 1e-3), 1 - 1e-3)
        lift = (F.col(f"{p}_hits") - mean * F.col(f"{p}_all")) / F.sqrt(F.col(f"{p}_squares") * mean * (1 - mean))
        lifted.append((F.abs(lift) >= MIN_LIFT).alias(p))
    kept = counts.where("n >= 3").select("f", *lifted).where(" OR ".join(p for p, _ in TARGETS)).toArrow()
    hashes = kept.column("f").to_numpy()
    return [np.sort(hashes[kept.column(p).to_numpy()]) for p, _ in TARGETS]


def fit(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Scorer, Scorer]:
    """(quality scorer, toxicity scorer).

    The label models count the votes of all documents. The scorers are fitted on
    about `sample_rows` distinct documents: first those in `labels` (doc_id,
    quality 0/1, toxic 0/1). A hand label is one vote more; for abuse such a document
    counts HAND_WEIGHT times, since the word lists know few languages. Labels without
    doc_id are ignored, of contradicting ones the worse counts. The driver gets the features that
    can have a weight and, one scorer after the other, their numbers by document.
    """
    sample = staged(learned_from(docs, labels, label_models(docs, text), text, sample_rows), "sample")
    scorers = []
    for (p, w), hashes in zip(TARGETS, telling(sample), strict=True):
        sent = sample.sparkSession.sparkContext.broadcast(hashes)

        def make(sent=sent):
            def run(batch: pa.RecordBatch) -> list:
                known, out = sent.value, []
                for f in batch.column("f"):
                    f = f.values.to_numpy(zero_copy_only=False)
                    at = np.searchsorted(known, f)
                    out.append(at[(at < len(known)) & (np.append(known, -1)[at] == f)].astype(np.int32))
                return [out]

            return run

        rows = extend(sample, [StructField("numbers", ArrayType(IntegerType()))], make, [p, w]).toArrow()
        numbers = rows.column("numbers").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
        row = np.repeat(np.arange(rows.num_rows, dtype=np.int32), np.diff(numbers.offsets.to_numpy()))
        scorers.append(Scorer().fit(hashes, row, numbers.flatten().to_numpy(), rows.column(p).to_numpy(), rows.column(w).to_numpy()))
    return scorers[0], scorers[1]


def judged(docs: DataFrame, scorers: tuple[Scorer, Scorer], text: str = "text", limit: float = 0.5,
           keep: list[str] | None = None) -> DataFrame:
    """`docs` with p_bad and p_toxic, the scorers' probabilities for each whole text, and rejected: either exceeds `limit`.

    Null counts as empty; a text without words has no evidence against it beyond
    the bias. Equal texts get equal scores. Input columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast([(s.table(), s.bias) for s in scorers])

    def make():
        tables = sent.value
        weighty = Weighty(set().union(*(w for w, _ in tables)))

        def run(batch: pa.RecordBatch) -> list:
            out = []
            for value in batch.column(text):
                found = weighty.of(*measures(value.as_py()))
                z = [bias + sum(map(weights.get, found, [0.0] * len(found))) for weights, bias in tables]
                out.append([float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in z])
            return [[p for p, _ in out], [t for _, t in out], [p > limit or t > limit for p, t in out]]

        return run

    return extend(docs, [StructField("p_bad", DoubleType()), StructField("p_toxic", DoubleType()), StructField("rejected", BooleanType())],
                  make, keep)


def classify(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", keep: list[str] | None = None,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`judged` by scorers fitted on the same documents; an empty table gives an empty result."""
    return judged(docs, fit(docs, labels, text, sample_rows), text, keep=keep)
