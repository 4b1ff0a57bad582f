"""Conversation prefix trie: union-find over the LCP edges of sorted neighbours, partition by partition.

Conversations are sorted by their turns and dealt out in ranges. Within a range
the edges between neighbours are taken in descending order of the turns that both ends share;
every merge of two components makes (or widens) a branching node. Only the nodes
on the paths of a range's first and last conversation can reach into another
range: each range is contracted to these two paths, and paths are merged across
boundaries by what the neighbours on either side share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField

from fleetlens.llm.common import extend, map_rows, quoted
from fleetlens.session import staged

#: Bytes that stand for a turn: the first half of a SHA-256 of its role and text.
TURN = 16
NOBODY = hashlib.sha256(b"").hexdigest()
CLOSED, PATH, EDGE = 0, 1, 2
FIELDS = [StructField("kind", IntegerType()), StructField("range", IntegerType()), StructField("conv_id", LongType()),
          StructField("depth", LongType()), StructField("parent_conv_id", LongType()), StructField("key", BinaryType()),
          StructField("parent_key", BinaryType()), StructField("n_convs", LongType()), StructField("n_children", LongType()),
          StructField("n_leaves", LongType()), StructField("saved_tokens", LongType()), StructField("ends", StringType()),
          StructField("on_first", BooleanType()), StructField("on_last", BooleanType()), StructField("above", LongType()),
          StructField("first", BinaryType()), StructField("last", BinaryType()), StructField("sums", ArrayType(LongType()))]
NAMES = [f.name for f in FIELDS]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, bytes>>): each conversation's turns in order, 16 bytes and a length for each.

    Turns are ordered by number (null first); equal numbers by role, then by the
    digest of role and text. A null role or text counts as empty, repeated rows are
    turns of their own, and rows without conv_id belong to no conversation. Other
    columns are not looked at. Texts are hashed where they are read and not moved; a
    conversation's digests come together in one row.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(quoted("conv_id").isNotNull()).select(quoted("conv_id").cast("bigint").alias("conv_id"), F.struct(
        quoted("turn").alias("turn"), role.alias("role"),
        F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * TURN))).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_heads(convs: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Conversations that borrow their first turns: the first h from conversation c - c % `group`, then their own after h.

    h is the unsigned crc32 of the decimal conv_id modulo `most` + 1. A conversation
    that is not there lends nothing, one that is shorter lends all it has.
    """
    convs = staged(convs, "sequences")
    c = F.col("conv_id")
    heads = convs.where(F.pmod(c, F.lit(group)) == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(c.cast("string")) % (most + 1)).cast("int")
    own = convs.withColumns({"base": c - F.pmod(c, F.lit(group)), "h": h})
    none = F.slice("turns", F.lit(1), F.lit(0))
    return own.join(heads, "base", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // TURN


class Forest:
    """The trie over one sorted range: every node once, each with its parent's place."""

    def __init__(self, ids: list[int], keys: list[bytes], sizes: list[list[int]]) -> None:
        self.ids, self.keys, self.sizes = ids, keys, sizes
        m = len(ids)
        self.ends_at = [len(k) // TURN for k in keys]
        self.nodes: list[tuple] = []  # (low, high, depth, smallest id, members, children, leaves, saved)
        self.parents: list[int] = []
        self.root, self.low, self.high = list(range(m)), list(range(m)), list(range(m))
        self.reached, self.smallest, self.members = self.ends_at[:], ids[:], [1] * m
        self.leaves, self.saved, self.open = [0] * m, [0] * m, [[] for _ in ids]
        shared = np.array([shared_turns(a, b) for a, b in zip(keys, keys[1:])], dtype=np.int64)
        for at in np.argsort(-shared, kind="stable").tolist():
            depth = int(shared[at])
            a, b = self.find(at), self.find(at + 1)
            self.climb(a, depth + 1)
            self.climb(b, depth + 1)
            self.unite(a, b)
        if m:
            self.climb(self.find(0), 0)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def climb(self, k: int, to: int) -> None:
        """Makes the nodes of a component from where it is up to depth `to`; none of them can get more members here."""
        while self.reached[k] >= to:
            depth, below, at = self.reached[k], self.open[k], len(self.nodes)
            for node in below:
                self.parents[node] = at
            if not below:
                self.leaves[k] = 1
            if depth:
                self.saved[k] += (self.members[k] - 1) * self.sizes[self.low[k]][depth - 1]
            self.nodes.append((self.low[k], self.high[k], depth, self.smallest[k], self.members[k], len(below), self.leaves[k], self.saved[k]))
            self.parents.append(-1)
            self.open[k], self.reached[k] = [at], depth - 1

    def unite(self, a: int, b: int) -> None:
        if len(self.open[a]) < len(self.open[b]):
            a, b = b, a
        self.root[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.smallest[a] = min(self.smallest[a], self.smallest[b])
        self.open[a] += self.open[b]
        for total in (self.members, self.leaves, self.saved):
            total[a] += total[b]

    def ends(self, node: tuple) -> str | None:
        """The ids of the conversations that end at a node: its first members, in ascending order."""
        at, high, depth = node[0], node[1], node[2]
        first = at
        while at <= high and self.ends_at[at] == depth:
            at += 1
        return ",".join(map(str, self.ids[first:at])) if at > first else None

    def rows(self, place: int) -> Iterator[tuple]:
        last = len(self.ids) - 1
        on_path = [n[0] == 0 or n[1] == last for n in self.nodes]
        sums = np.cumsum([0, *self.sizes[0]]).tolist()
        digest = [hashlib.blake2b(self.keys[n[0]][:TURN * n[2]], digest_size=TURN).digest() if own else None
                  for n, own in zip(self.nodes, on_path, strict=True)]
        for node, own, key, up in zip(self.nodes, on_path, digest, self.parents, strict=True):
            low, high, depth, smallest, members, children, leaves, saved = node
            ends = self.ends(node)
            parent_key = digest[up] if up >= 0 else None
            counts = (members, children, leaves, saved)
            if own:
                above = sums[max(depth, 1) - 1] if low == 0 else 0
                yield (PATH, place, smallest, depth, None, key, parent_key, *counts, ends, low == 0, high == last, above, None, None, None)
            else:
                parent = None if parent_key else self.nodes[up][3]
                ends = hashlib.sha256(ends.encode()).hexdigest() if ends else NOBODY
                yield (CLOSED, place, smallest, depth, parent, None, parent_key, *counts, ends, None, None, None, None, None, None)
        yield (EDGE, place, *[None] * 13, self.keys[0], self.keys[last], sums)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    ids, keys, sizes = [], [], []
    for batch in batches:
        ids += batch.column("conv_id").to_pylist()
        keys += batch.column("key").to_pylist()
        sizes += batch.column("sizes").to_pylist()
    if not ids:
        return
    kinds, out = [to_arrow_type(f.dataType) for f in FIELDS], []
    for row in Forest(ids, keys, sizes).rows(TaskContext.get().partitionId()):
        out.append(row)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], NAMES)
            out = []
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], NAMES)


def _boundaries(made: DataFrame) -> DataFrame:
    """(range, before, after, turns, lent): turns shared with the ranges on either side, the last conversation's turns, and the bytes of the `before` ones.

    One row a range goes in and comes out.
    """
    order = Window.orderBy("range")
    beside = made.where(F.col("kind") == EDGE).select(
        "range", "first", "last", "sums", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))

    def make():
        def run(batch: pa.RecordBatch) -> list:
            out = []
            for first, last, sums, left, right in zip(*[batch.column(c).to_pylist() for c in ("first", "last", "sums", "left", "right")], strict=True):
                before = -1 if left is None else shared_turns(left, first)
                out.append((before, -1 if right is None else shared_turns(last, right), len(last) // TURN, sums[max(before, 0)]))
            return [list(c) for c in zip(*out, strict=True)]

        return run

    names = ("before", "after", "turns", "lent")
    return extend(beside, [StructField(n, LongType()) for n in names], make, ["range"])


def _joined_ends(pieces: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of each key's pieces joined by commas in order of ranges, hashed as they stream by."""
    rows = pieces.select("key", "range", "ends").repartition("key").sortWithinPartitions("key", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key == held:
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                state.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([e for _, e in out])], ["key", "ends"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    return map_rows(rows, run, [StructField("key", BinaryType()), StructField("ends", StringType())])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    `convs` has (conv_id, turns array<struct<digest, bytes>>), one row per
    conversation. A node is named by its smallest member and its depth; the root has
    depth 0 and no parent. n_leaves counts the childless nodes of its subtree (itself
    included), saved_tokens sums (members - 1) * bytes of the last turn over the
    subtree, ends_sha256 hashes the ascending ids of the members that end there.

    Copies of one conversation, however many, are dealt over ranges by their
    id; a range's two outer paths are all that is merged with others. What a node's
    end hash needs is streamed in order, so its ids are never held together. A
    conversation without turns ends at the root; rows without conv_id are ignored, as
    are other columns; no conversations give no nodes.
    """
    sizes = F.transform("turns", lambda t: t["bytes"])
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = convs.where(quoted("conv_id").isNotNull()).select(quoted("conv_id").cast("bigint").alias("conv_id"), key.alias("key"), sizes.alias("sizes"))
    dealt = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = staged(map_rows(dealt, _forests, FIELDS), "forests")

    path = made.where(F.col("kind") == PATH).join(_boundaries(made), "range")
    known = F.col("on_first") & (F.col("depth") <= F.col("before"))  # the range before has this node too
    less = lambda c: F.when(c, 1).otherwise(0)
    sums = {
        "n_convs": F.col("n_convs"),
        "n_children": F.col("n_children") - less(F.col("on_first") & (F.col("depth") < F.col("before"))),
        "n_leaves": F.col("n_leaves") - less(F.col("on_last") & (F.col("after") == F.col("turns"))),
        "saved_tokens": F.col("saved_tokens") + F.when(known, F.col("lent") - F.col("above")).otherwise(0)}
    merged = staged(path.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
        *[F.sum(v).cast("bigint").alias(k) for k, v in sums.items()]), "paths")
    named = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    ends = _joined_ends(made.where((F.col("kind") == PATH) & F.col("ends").isNotNull()))
    shared = merged.join(named, "parent_key", "left").join(ends, "key", "left")

    # Below a path node: its smallest member is looked up once for each range that has it.
    at = made.where(F.col("kind") == PATH).select("range", F.col("key").alias("parent_key")).join(named, "parent_key")
    closed = made.where(F.col("kind") == CLOSED)
    under = closed.where(F.col("parent_key").isNotNull()).join(at, ["range", "parent_key"])
    inside = closed.where(F.col("parent_key").isNull()).withColumn("parent", F.col("parent_conv_id"))

    def shaped(df: DataFrame) -> DataFrame:
        parent: Column = F.col("parent").cast("bigint").alias("parent_conv_id")
        return df.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))

    return shaped(shared).unionByName(shaped(under)).unionByName(shaped(inside))
