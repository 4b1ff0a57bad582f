"""I-Match fingerprints: hashes of the distinct mid-frequency terms within randomised subsets of the lexicon."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField

from fleetlens.llm.common import NO_ID, extend, map_rows, quoted
from fleetlens.llm.fm_index import words_of

#: Each subset keeps a lexicon term with probability 2**-level: the whole lexicon once, then sparser and sparser draws.
LEVELS = np.array([0] + [4] * 8 + [7] * 16 + [10] * 16)
SALTS = np.random.default_rng(1948).integers(1, 2 ** 63, len(LEVELS), dtype=np.uint64)
WIDTH = 8  # hex digits of one hash
NONE = "-" * WIDTH
#: A task hands on its term counts when it has gathered so many terms.
FLUSH = 200_000


def _members(terms: np.ndarray) -> np.ndarray:
    """For each term hash the bit set of the lexicon subsets that keep it."""
    x = terms[:, None] ^ SALTS[None, :]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    kept = (x >> np.uint64(20)) & ((np.uint64(1) << LEVELS.astype(np.uint64)) - np.uint64(1)) == 0
    return (kept.astype(np.uint64) << np.arange(len(LEVELS), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Fingerprinter:
    def __init__(self, lexicon: list[bytes]) -> None:
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in lexicon], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.place = {lexicon[i]: rank for rank, i in enumerate(order.tolist())}
        self.members = np.concatenate([_members(part) for part in np.array_split(self.hashes, len(lexicon) // 10_000 + 1)])

    def __call__(self, text: str | None) -> str:
        distinct = set(words_of(text))
        known = self.place.keys() & distinct
        if known:
            at = np.array(sorted(map(self.place.__getitem__, known)))
            terms, members = self.hashes[at], self.members[at]
        elif distinct:
            terms = np.array(sorted(map(xxhash.xxh3_64_intdigest, distinct)), dtype=np.uint64)
            members = _members(terms)
        else:
            return hashlib.blake2b((text or "").encode(), digest_size=WIDTH // 2).hexdigest() + NONE * (len(LEVELS) - 1)
        inside = (members[:, None] >> np.arange(len(LEVELS), dtype=np.uint64)[None, :]) & np.uint64(1) != 0
        return "".join(hashlib.blake2b(terms[column].tobytes(), digest_size=WIDTH // 2).hexdigest() if column.any() else NONE
                       for column in inside.T)


def likeness(a: str, b: str) -> float:
    """The share of subsets with equal hashes among those that hold a term of either text; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    same = held = 0
    for at in range(0, len(a), WIDTH):
        x, y = a[at:at + WIDTH], b[at:at + WIDTH]
        if x != NONE or y != NONE:
            held += 1
            same += x == y
    return same / held if held else 0.0


def lexicon(docs: DataFrame, min_share: float = 0.0005, max_share: float = 0.1, text: str = "text") -> list[bytes]:
    """The terms that occur in `min_share` to `max_share` of all documents: an inverse-document-frequency band.

    Terms are runs of 0-9, a-z and non-ASCII characters after A-Z went to lower case.
    Frequencies are exact counts over all documents, combined within each task first.
    A band that ends at a share holds at most (mean distinct terms a document) /
    min_share terms, however many documents there are, so it can be broadcast.
    """
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def give():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column("text"):
                counts.update(set(words_of(value.as_py())))
                if len(counts) >= FLUSH:
                    yield give()
        yield give()

    counts = map_rows(docs.select(quoted(text).alias("text")), run, [StructField("term", BinaryType()), StructField("n", LongType())])
    band = counts.groupBy("term").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= total * min_share) & (F.col("n") <= max(1, total * max_share)))
    return sorted(bytes(r.term) for r in band.select("term").toLocalIterator())


def fingerprints(docs: DataFrame, terms: list[bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with the I-Match fingerprint of each whole text in `fingerprint`.

    The text's distinct terms within the lexicon are sorted, and those of each
    subset hashed. A text without lexicon terms is judged by all its terms; one
    without terms (null, empty, punctuation) by the hash of the text, null as
    empty. Equal texts have equal fingerprints; term order and repeats don't count.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        fingerprint = Fingerprinter(sent.value)
        return lambda batch: [[fingerprint(v.as_py()) for v in batch.column(text)]]

    return extend(docs, [StructField("fingerprint", StringType())], make, keep)


def _bucket(value: Column, bounds: list[int], low: int = 0) -> Column:
    """How many of the sorted bounds are at most `value`, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _bucket(value, bounds[:mid], low)).otherwise(
        _bucket(value, bounds[mid + 1:], low + mid + 1))


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, copied, id, text): documents dealt into ranges of doc_id, sorted within; after each range the next one's first rows.

    Bounds come from the ids alone, and the first document of a range is sent to the
    range before it, of the first range to the last. Whoever reads a range in order
    meets every document's successor, and no task holds more than a range.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(quoted("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), quoted(text).alias("text"))
    bounds = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], F.lit(max(10_000, 10 * n))).alias("b")).first()["b"]
    bucket = _bucket(F.col("id"), sorted(set(bounds or [])))
    firsts = sorted(tuple(r) for r in rows.groupBy(bucket.alias("k")).agg(F.min("id")).collect())
    heads = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    first_of = F.broadcast(spark.createDataFrame(heads, "id bigint, before int"))
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("copied"))
    sent = rows.join(first_of, "id", "left").select("id", "text", F.explode(F.when(
        F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copied"))))).alias("at"))
    return sent.select("at.bucket", "at.copied", "id", "text").repartition(n, "bucket").sortWithinPartitions("bucket", "copied", "id", "text")


def compared_with_next(docs: DataFrame, terms: list[bytes], text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of `docs`.

    The edited text is the text with its last floor(n_chars / 2) code points replaced
    by the first as many (or all) of the next document by doc_id; the first follows
    the last. Rows that share a doc_id follow each other by text; rows without one
    come first. A single document is its own successor; null text counts as empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    fields = [StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
              StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
              StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]
    if docs.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                                     "edited_fingerprint string, near_edited double, near_next double")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = Fingerprinter(sent.value)
        out: list[tuple] = []
        held = None  # (bucket, id, text, fingerprint) of the document that waits for its successor

        def give():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], [f.name for f in fields])
            out.clear()
            return made

        for batch in batches:
            for bucket, copied, ident, value in zip(*[batch.column(c) for c in ("bucket", "copied", "id", "text")], strict=True):
                bucket, copied = bucket.as_py(), copied.as_py()
                if copied and (held is None or held[0] != bucket):
                    continue  # the successor is known already
                body = value.as_py() or ""
                mark = fingerprint(body)
                if held is not None and held[0] == bucket:
                    _, last, own, own_mark = held
                    half = len(own) // 2
                    edited = own[:len(own) - half] + body[:half]
                    edited_mark = fingerprint(edited)
                    out.append((None if last == NO_ID else last, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark,
                                edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                    if len(out) >= 512:
                        yield give()
                held = None if copied else (bucket, ident.as_py(), body, mark)
        if out:
            yield give()

    return map_rows(in_order(docs, text), run, fields)
