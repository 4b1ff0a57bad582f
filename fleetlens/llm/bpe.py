"""Byte-level BPE by a rank queue, and back."""

from __future__ import annotations

import base64
import gc
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from fleetlens.llm.common import extend, held, read_file

#: Pre-tokens a worker remembers at most, in two generations: when the younger one is full, the older one goes.
MEMO = 800_000
#: A pre-token is remembered when it is seen a second time; first sights leave a mark at one of so many places.
MARKS = 1 << 24
#: Longer pre-tokens are encoded anew each time instead of being remembered.
MEMO_CHARS = 64
#: What a worker keeps goes by these names: to encode, to decode.
HOLDS, HOLDS_TOKENS = "bpe", "bpe_tokens"

BITS = [1 << i for i in range(256)]


def read_ranks(table: bytes) -> dict[bytes, int]:
    """Tokens and their ranks from tiktoken's file format."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}


class Merger:
    """Merges of one pre-token by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = [0] * ((max(ranks.values(), default=-1) + 1 >> 8) + 1)

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: the leftmost pair of lowest rank merges until none is left.

        The queue of possible merges has a bucket of positions per rank. A bit per
        non-empty bucket, in words of 256 bits, and above them a bit per non-zero word
        make the next rank two find-first-set steps. Tokens are a linked list of their
        start positions. Nothing is searched for removal: an entry whose position no
        longer starts a pair of that rank is stale and skipped. A pre-token of n bytes
        takes n log n steps, so very long ones are no trouble.
        """
        find, n = self.ranks.get, len(raw)
        whole = find(raw)
        if whole is not None:
            return [whole]
        after = list(range(1, n + 2))  # start of the next token
        before = list(range(-1, n))
        pair = [-1] * n  # rank of the merge with the next token, the current one only
        words, buckets, top = self.words, {}, 0

        def push(rank: int, at: int) -> int:
            """Enters a position and returns the bit of the rank's word when that was empty."""
            bucket = buckets.get(rank)
            if bucket is not None:
                heappush(bucket, at)
                return 0
            buckets[rank] = [at]
            high = rank >> 8
            word = words[high]
            words[high] = word | BITS[rank & 255]
            return 0 if word else 1 << high

        for at in range(n - 1):
            rank = find(raw[at:at + 2], -1)
            if rank >= 0:
                pair[at] = rank
                top |= push(rank, at)
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                word ^= low
                words[high] = word
                if not word:
                    top ^= 1 << high
            if pair[at] != rank:
                continue
            gone = after[at]
            end = after[at] = after[gone]
            pair[gone] = rank = -1
            if end < n:
                before[end] = at
                rank = find(raw[at:after[end]], -1)
                if rank >= 0:
                    top |= push(rank, at)
            pair[at] = rank
            left = before[at]
            if left >= 0:
                rank = pair[left] = find(raw[left:end], -1)
                if rank >= 0:
                    top |= push(rank, left)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at:after[at]]])
            at = after[at]
        return out


class Codec:
    """Encoder over a table of ranks. Nothing in it refers back to it, so all of it goes as soon as it is let go."""

    def __init__(self, table: bytes, pattern: str) -> None:
        self.ranks = read_ranks(table)
        # White space as Unicode has it, whatever the regex library takes \s to be.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo = Memo(Merger(self.ranks).piece)

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, self.split(text or ""))), dtype=np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.memo.__getitem__, self.split(text or ""))))

    def decode(self, ids: np.ndarray) -> bytes:
        return Tokens(self.ranks).decode(ids)


class Tokens:
    """The bytes of every token, one behind the other: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, rank in ranks.items():
            tokens[rank] = raw
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        begins = np.cumsum(sizes) - sizes
        return self.bytes[np.repeat(self.starts[ids] - begins, sizes) + np.arange(int(sizes.sum()))].tobytes()


class Memo(dict):
    """Ids by pre-token, filled as they are asked for: about half of all distinct pre-tokens occur once and are never kept."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}
        self.marks = bytearray(MARKS)

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            ids = tuple(self.encode(text.encode()))
            if len(text) > MEMO_CHARS:
                return ids
            at = hash(text) % MARKS
            if not self.marks[at]:
                self.marks[at] = 1
                return ids
        if 2 * len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
            self.marks = bytearray(MARKS)
        self[text] = ids
        return ids


def codec(table: bytes, pattern: str) -> Codec:
    """One codec per Python worker: the tasks that a worker runs in turn share what it remembers.

    That is a million small immutable objects, which the cycle collector would walk
    over and over, so it is called less often.
    """
    gc.set_threshold(100_000, 50, 100)
    return held(HOLDS, (table, pattern), lambda: Codec(table, pattern))


def _table(docs: DataFrame, path: str):
    """The vocabulary file, read once by the driver and sent to every executor (about a megabyte)."""
    return docs.sparkSession.sparkContext.broadcast(read_file(path))


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
               keep: list[str] | None = None) -> DataFrame:
    """`docs` with the array of token ids of each whole text in column `ids`.

    `pattern` cuts the text into pre-tokens, each merged separately by the ranks in
    the file at `path`. No special tokens. Null and empty texts have no ids; a
    pre-token of any length takes n log n steps. Rows are independent of each
    other, so repeated rows repeat their result. An input column `ids` is replaced.
    """
    table = _table(docs, path)

    def make():
        own = codec(table.value, pattern)

        def encode(batch: pa.RecordBatch) -> list:
            ends, parts = [0], []
            for value in batch.column(text):
                part = own.encode(value.as_py())
                parts.append(part)
                ends.append(ends[-1] + len(part))
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]

        return encode

    return extend(docs, [StructField(ids, ArrayType(IntegerType()))], make, keep, holds=HOLDS)


def bpe_count(docs: DataFrame, path: str, pattern: str, text: str = "text", count: str = "n_tokens",
              keep: list[str] | None = None) -> DataFrame:
    """`docs` with the number of token ids of each whole text (0 for null), as `bpe_encode` would give them."""
    from pyspark.sql.types import LongType

    table = _table(docs, path)

    def make():
        own = codec(table.value, pattern)
        return lambda batch: [[own.count(value.as_py()) for value in batch.column(text)]]

    return extend(docs, [StructField(count, LongType())], make, keep, holds=HOLDS)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`rows` with the bytes that each array of ids stands for; null for a null array.

    An id that the file does not hold is an error.
    """
    table = _table(rows, path)

    def make():
        own = held(HOLDS_TOKENS, table.value, lambda: Tokens(read_ranks(table.value)))

        def decode(batch: pa.RecordBatch) -> list:
            column = batch.column(ids)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            return [[own.decode(values[a:b]) if known else None
                     for a, b, known in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]]

        return decode

    return extend(rows, [StructField(out, BinaryType())], make, keep, holds=HOLDS_TOKENS)
