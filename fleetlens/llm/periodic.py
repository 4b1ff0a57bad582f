"""Periodic runs of words, as maximal pairs of an LCP-interval tree.

A stretch of length L with period p is a pair of places p words apart that share
their next L - p words, differ after them, and differ in the word before: a
maximal pair. So the runs of a text are its maximal pairs whose distance is short
against what they share, and nothing has to be extended.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fleetlens.llm.common import extend, let, quoted

#: Texts are sorted together until they have so many words; a longer text is sorted alone.
WORDS = 100_000
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])


def shared_stretches(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the places that share `least` tokens or more with another place, in suffix order, each with what it shares with the one before.

    Prefix doubling over places that still have company, so a text without long
    repeats is sorted a few times and then done. Ranks of each doubling are kept;
    shared lengths are read off them from the longest down.
    """
    n = len(tokens)
    at = np.argsort(tokens, kind="stable")
    here = np.arange(n)
    fresh = np.diff(tokens[at], prepend=-1) != 0
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[at] = np.maximum.accumulate(np.where(fresh, here, 0))
    company = ~fresh | np.append(~fresh[1:], False)
    alive, size, levels, pool = at[company], 1, [rank.astype(np.int32)], None
    while True:
        if 2 * size > least and pool is None:
            pool = alive
        if not len(alive):
            break
        key = rank[alive] * (n + 1) + rank[alive + size] + 1
        turn = np.argsort(key, kind="stable")
        alive, key = alive[turn], key[turn]
        old, here = rank[alive], np.arange(len(alive))
        fresh = np.diff(key, prepend=-1) != 0
        first = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, here, 0))
        rank[alive] = old + np.maximum.accumulate(np.where(fresh, here, 0)) - first
        size *= 2
        levels.append(rank.astype(np.int32))
        alive = alive[~fresh | np.append(~fresh[1:], False)]
    if pool is None or not len(pool):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = pool[np.argsort(rank[pool])]
    lcp = np.zeros(len(order), dtype=np.int64)
    for power in range(len(levels) - 1, -1, -1):
        level = levels[power]
        same = level[order[1:] + lcp[1:]] == level[order[:-1] + lcp[1:]]
        lcp[1:] += same.astype(np.int64) << power
    lcp[lcp < least] = 0
    return order, lcp


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], min_words: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """{(start, length): smallest period} from the intervals of the tree, innermost first.

    An interval holds its places in one sorted list and, by the word before them,
    in class lists. When two children of an interval with `depth` shared tokens meet, the
    smaller's places look in the larger for partners of another class within
    depth / (min_exponent - 1). To the right only the nearest place can be one: two would
    make the stretch periodic with their distance, and the nearer one would share more. To
    the left only one place of another class can be within reach, and it comes first there,
    for the same reason; the class lists tell by two searches whether there is one.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, length: int, period: int) -> None:
        if length >= min_words and found.get((start, length), period) >= period:
            found[start, length] = period

    def joined(a: tuple[list, dict], b: tuple[list, dict], depth: int) -> tuple[list, dict]:
        if len(a[0]) < len(b[0]):
            a, b = b, a
        places, classes = a
        reach, last = depth // (min_exponent - 1), len(places)
        for at in b[0]:
            k = bisect_left(places, at)
            if k < last and places[k] - at <= reach and left[places[k]] != left[at]:
                keep(at, depth + places[k] - at, places[k] - at)
            if k and at - places[k - 1] <= reach:
                low = bisect_left(places, at - reach, 0, k)
                own = classes.get(left[at], ())
                if k - low > bisect_left(own, at) - bisect_left(own, at - reach):
                    keep(places[low], depth + at - places[low], at - places[low])
        _merge(places, b[0])
        for word, more in b[1].items():
            held = classes.setdefault(word, more)
            if held is not more:
                _merge(held, more)
        return a

    open_: list[tuple[int, tuple[list, dict]]] = []
    for at, up in zip(order, [*lcp[1:], 0], strict=True):
        node = ([at], {left[at]: [at]})
        while open_ and open_[-1][0] >= max(up, 1):
            depth, older = open_.pop()
            node = joined(older, node, depth)
        if up:
            open_.append((up, node))
    return found


def _merge(into: list[int], more: list[int]) -> None:
    """Adds sorted places to a sorted list."""
    if len(more) > 32:
        into += more
        into.sort()
    else:
        for x in more:
            insort(into, x)


def _runs_of(texts: list[list[bytes]], min_words: int, min_exponent: int) -> Iterator[list[tuple[int, int, int]]]:
    """The (start, length, period) of each text's runs by start, then period; texts are sorted together."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    out: list[list] = [[] for _ in texts]
    if sizes.sum():
        words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        tokens = owner * (int(words.max()) + 1) + words
        least = max(1, -(-min_words * (min_exponent - 1) // min_exponent))
        order, lcp = shared_stretches(tokens, least)
        if len(order):
            before = np.concatenate([[-1], tokens[:-1]])
            before[begins[sizes > 0]] = -1 - np.arange(int((sizes > 0).sum()))  # a text's start is a class of its own
            found = maximal_pairs(order.tolist(), lcp.tolist(), before.tolist(), min_words, min_exponent)
            starts = np.array([s for s, _ in found], dtype=np.int64)
            for (start, length), k in zip(found, (owner[starts] if len(starts) else []), strict=True):
                out[k].append((start - int(begins[k]), length, found[start, length]))
    for runs in out:
        yield sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in kept])


def periodic_runs(docs: DataFrame, min_words: int = 24, min_exponent: int = 3, text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """`docs` with `runs`, array<struct<start, length, period>> by start, then period, and `collapsed`, the text without repeats.

    Words are what lies between ASCII white space, numbered from 0. A run is a
    stretch of at least `min_words` words and `min_exponent` (2 or more) times its
    smallest period that cannot be extended with that period. `collapsed` leaves out the
    words that any run holds after its first period and joins the others by one space.

    Null, empty and blank texts have no runs and collapse to an empty text. Each row
    is judged by its own whole text, so repeated rows repeat their result and other
    columns (a null doc_id too) don't matter; input columns named like the new ones are replaced. A very
    long text takes n log n steps and a few dozen bytes a word in one task. An empty table
    gives an empty result.
    """
    if min_words < 1 or min_exponent < 2:
        raise ValueError("min_words must be at least 1 and min_exponent at least 2")

    def make():
        def run(batch: pa.RecordBatch) -> list:
            runs, texts = [], []

            def judge(waiting: list[list[bytes]]) -> None:
                for words, found in zip(waiting, _runs_of(waiting, min_words, min_exponent), strict=True):
                    runs.append([dict(zip(RUN.names, r, strict=True)) for r in found])
                    texts.append(collapsed(words, found).decode())

            waiting, size = [], 0
            for value in batch.column(text):
                words = (value.as_py() or "").encode().split()
                if waiting and size + len(words) > WORDS:
                    judge(waiting)
                    waiting, size = [], 0
                waiting.append(words)
                size += len(words)
            judge(waiting)
            return [runs, texts]

        return run

    return extend(docs, [StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())], make, keep)


def with_loops(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a tenth of the texts ending in a loop, chosen by the crc32 of doc_id: known runs to look for.

    With h = crc32(decimal doc_id) and g = h div 10, a text of n words whose h
    ends in 0 repeats from word g % n on with period 1 + (n - g % n) div (3 + g % 8). Its words are then
    joined by one space. Texts without words and rows without doc_id stay as they are.
    """
    h = F.crc32(quoted("doc_id").cast("string"))
    g = F.floor(h / 10)

    def loop(line):
        # Stretches of the line are copied whole: words in arrays, and a lambda for each, leave hundreds of bytes a word on the heap.
        first = lambda s, k: F.call_function("substring_index", s, F.lit(" "), k.cast("int"))

        def looped(n, a, p):
            rest = (n - a) % p
            return let(first(line, a + p), lambda head: let(first(head, -p), lambda turn: F.concat(
                head, F.repeat(F.concat(F.lit(" "), turn), (F.floor((n - a) / p) - 1).cast("int")),
                F.when(rest > 0, F.concat(F.lit(" "), first(turn, rest))).otherwise(""))))

        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        return F.when(line != "", let(count.cast("bigint"), lambda n: let(g % n, lambda a: let(
            1 + F.floor((n - a) / (3 + g % 8)), lambda p: looped(n, a, p)))))

    line = F.trim(F.regexp_replace(quoted(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    return docs.withColumn(text, F.when(h % 10 == 0, F.coalesce(let(line, loop), quoted(text))).otherwise(quoted(text)))
