"""Benchmark decontamination: an FM-index per shard of training text, searched backwards for test phrases.

The index covers the stretches of a shard that consist of benchmark words only
and are long enough to hold a phrase. A phrase holds no other words, so no
occurrence is lost, and a shard's index stays small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from fleetlens.llm.common import extend, quoted
from fleetlens.session import staged

#: Benchmark text taken per pass, in bytes: what is broadcast stays near this bound.
BLOCK_BYTES = 4_000_000
#: Documents per shard, and the distance of sampled suffix positions.
SHARD_ROWS, SAMPLE = 2048, 8

#: Bytes outside words become blanks and A-Z become a-z; all bytes of non-ASCII characters belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Phrases:
    """The distinct windows of some items as rows of word numbers; number 0 is any other word."""

    size: int
    words: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], int] = field(default_factory=dict)
    items: list[set] = field(default_factory=list)

    def add(self, item: object, text: str | None) -> None:
        numbers = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
        n = min(self.size, len(numbers))
        for at in range(len(numbers) - n + 1 if numbers else 0):
            window = tuple(numbers[at:at + n])
            place = self.windows.setdefault(window, len(self.items))
            if place == len(self.items):
                self.items.append(set())
            self.items[place].add(item)

    def packed(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, list[list]]:
        lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        table = np.zeros((len(lengths), int(lengths.max(initial=1))), dtype=np.int64)
        for row, window in enumerate(self.windows):
            table[row, :len(window)] = window
        return self.words, table, lengths, [sorted(s) for s in self.items]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions in suffix order. Each 0 ends its suffixes and is a symbol of its own."""
    n = len(text)
    ends = text == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, text + n_ends).astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max(initial=0)) + n + 2 + int(ahead.max(initial=0))) + ahead if step == 1 else rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        at = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
        rank = fresh
        if n == 0 or int(rank.max()) == n - 1:
            return order
        step *= 2


class WaveletRanks:
    """How often a symbol occurs before a position, level by level over the symbols' bits."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.ones, self.zeros = [], []
        self.bits = max(1, int(symbols - 1).bit_length())
        for level in reversed(range(self.bits)):
            bit = (sequence >> level) & 1
            count = np.zeros(len(sequence) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(sequence) - int(count[-1]))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.start = self._descend(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            before = ones[at]
            at = np.where((symbol >> level) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search over a text of word numbers in which 0 separates stretches; the text ends with 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text)
        self.last = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:symbols]
        self.ranks = WaveletRanks(self.last, symbols)
        # Starts of stretches are sampled too, so a walk never leaves its stretch.
        known = (order % SAMPLE == 0) | (self.last == 0)
        self.place = np.where(known, order, -1)
        self.n = len(text)

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of every phrase."""
        low, high = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), self.n, dtype=np.int64)
        for back in range(1, table.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = table[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled one and count the steps."""
        found, steps, rows = np.empty(len(rows), dtype=np.int64), 0, rows.copy()
        live = np.arange(len(rows))
        while len(live):
            place = self.place[rows[live]]
            done = place >= 0
            found[live[done]] = place[done] + steps
            live = live[~done]
            symbol = self.last[rows[live]]
            rows[live] = self.first[symbol] + self.ranks.rank(symbol, rows[live])
            steps += 1
        return found


def find_phrases(numbers: list[np.ndarray], table: np.ndarray, lengths: np.ndarray, symbols: int):
    """(document, word, phrase) arrays of every occurrence of a phrase in a shard of word-number arrays."""
    none = np.empty(0, dtype=np.int64)
    shortest = int(lengths.min(initial=0))
    sizes = np.array([len(x) for x in numbers], dtype=np.int64)
    if not len(lengths) or not sizes.sum():
        return none, none, none
    # One 0 behind each document; positions of the flat text are kept for the way back.
    flat = np.zeros(int(sizes.sum() + len(sizes)), dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    for begin, part in zip(begins, numbers, strict=True):
        flat[begin:begin + len(part)] = part
    edge = np.diff((flat != 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none
    spans = ends - starts + 1
    origin = np.repeat(starts - np.concatenate(([0], np.cumsum(spans)))[:-1], spans) + np.arange(int(spans.sum()))
    text = flat[np.minimum(origin, len(flat) - 1)]
    text[np.cumsum(spans) - 1] = 0
    index = FMIndex(text, symbols)
    low, high = index.search(table, lengths)
    hits = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(lengths)), hits)
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(hits)))[:-1], hits) + np.arange(int(hits.sum()))
    where = origin[index.locate(rows)]
    doc = np.searchsorted(begins, where, side="right") - 1
    return doc, where - begins[doc], phrase


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])


def _scan(rows: DataFrame, phrases: Phrases, item_type, text: str, keep: list[str] | None) -> DataFrame:
    """One pass for some of the items, added to what earlier passes found."""
    packed = rows.sparkSession.sparkContext.broadcast(phrases.packed())
    earlier = "word_spans" in rows.columns
    fields = [StructField("n_words", LongType()), StructField("word_spans", ArrayType(SPAN)),
              StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(item_type))]

    def make():
        words, table, lengths, items = packed.value
        number = words.get

        def scan(batch: pa.RecordBatch) -> list:
            texts = batch.column(text)
            numbers = []
            for value in texts:
                numbers.append(np.array([number(w, 0) for w in words_of(value.as_py())], dtype=np.int32))
            docs, places, found = find_phrases(numbers, table, lengths, len(words) + 1)
            spans: dict[int, set] = {}
            names: dict[int, set] = {}
            for doc, place, phrase in zip(docs.tolist(), places.tolist(), found.tolist(), strict=True):
                spans.setdefault(doc, set()).add((place, place + int(lengths[phrase])))
                names.setdefault(doc, set()).update(items[phrase])
            word_spans, char_spans, ids = [], [], []
            for doc in range(batch.num_rows):
                runs, got = list(spans.get(doc, ())), names.get(doc, set())
                if earlier:
                    runs += [(s["begin"], s["end"]) for s in batch.column("word_spans")[doc].as_py()]
                    got = got | set(batch.column("items")[doc].as_py())
                runs = merge_spans(runs)
                at = [m.span() for m in WORD.finditer(texts[doc].as_py())] if runs else []
                word_spans.append([{"begin": a, "end": b} for a, b in runs])
                char_spans.append([{"begin": at[a][0], "end": at[b - 1][1]} for a, b in runs])
                ids.append(sorted(got))
            return [[len(x) for x in numbers], word_spans, char_spans, ids]

        return scan

    return extend(rows, fields, make, keep, SHARD_ROWS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                  keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, word_spans, spans (code points, end exclusive), and items, the ids of the items met.

    Words are runs of 0-9, a-z and non-ASCII characters after A-Z went to lower case.
    A phrase is `window` consecutive words of an item, or all of an item with fewer
    words; every word within an occurrence is hit, and hit words that touch are one
    span. Items are taken in blocks of about `block_bytes` of text, one pass over the
    documents each, so what is broadcast doesn't grow with the benchmark.

    Null and empty texts have no words and no hits; items without words or without
    an id match nothing; repeated items count once; repeated documents repeat their
    result. Input columns named like the new ones are replaced.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("_llm_text"))
    size = items.agg(F.sum(F.octet_length("_llm_text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    item_type = items.schema["item_id"].dataType
    rows = docs.drop("word_spans", "items") if {"word_spans", "items"} & set(docs.columns) else docs
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "_llm_text"), F.lit(blocks)) == block)
        phrases = Phrases(window)
        for item, body in part.distinct().toLocalIterator():
            phrases.add(item, body)
        names = None if keep is None or block < blocks - 1 else keep
        rows = _scan(rows, phrases, item_type, text, names)
        if block < blocks - 1:
            rows = staged(rows, "contamination")
    return rows


def without_spans(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """`rows` with the spans cut out of `text`, one blank in the place of each; the text stays null if it was."""
    body, cuts = quoted(text), quoted(spans)
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"]))
    ends = F.concat(F.transform(cuts, lambda s: s["begin"]), F.array(F.char_length(body)))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(body, a + F.lit(1), b - a)), " ")
    return rows.withColumn(text, F.when(F.size(cuts) > 0, kept).otherwise(body))
