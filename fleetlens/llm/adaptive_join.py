"""Documents linked by the Jaccard similarity of their word n-grams, joined over adaptive multi-match prefixes.

All sets are ordered alike (by hash). Two sets that share `o` tokens have at least l of
them in common within their first n - o + l tokens, for any l: the longer the
prefixes, the more they must share. Each document takes the l that makes its
candidates cheapest, and two documents are compared only if their prefixes share as many tokens
as the smaller of their two l asks for, or more where their sizes ask for more.
A token that one set alone has is missing from any partner, so a set with too many of them has none, whatever its prefix meets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from fleetlens.llm.common import NO_ID, extend, map_rows, quoted, two_way_join
from fleetlens.llm.components import components
from fleetlens.llm.hyperminhash import shingles
from fleetlens.session import discard, staged

#: The largest l of a document is 1 + a twentieth of its tokens.
SHARE = 20
#: Tokens and documents in a block, at most, when the rest of a family is joined; a document beyond that is a block.
BLOCK_TOKENS, BLOCK = 2 ** 21, 2048
#: All tokens of prefixes or sets are dealt in so many parts, one after the other; a part's shuffle files go before the next.
SLICES = 4


def most(n: int) -> int:
    return 1 + n // SHARE


def needed(n, percent: int):
    """The tokens that any partner of a set of n shares with it at least."""
    return -(-percent * n // 100)


def smallest_linked(percent: int) -> int | None:
    """The fewest tokens of a set that can be linked to a different one: n / (n + 1) must reach the limit."""
    return None if percent >= 100 else -(-percent // (100 - percent))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(a), int(b)


def texts(docs: DataFrame, text: str) -> DataFrame:
    """(doc, h, text): every row with a digest of its text."""
    return docs.select(F.coalesce(quoted("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
                       F.unhex(F.md5(quoted(text).cast("binary"))).alias("h"), quoted(text).alias("text"))


def heads(docs: DataFrame, words: int, percent: int, text: str = "text") -> DataFrame:
    """(doc, h, n, a, b, head) per row: the text's digest, the set's size, a 128-bit key of it, and the longest prefix that it may need."""
    rows = texts(docs, text)
    fields = [StructField("n", LongType()), StructField("a", LongType()), StructField("b", LongType()), StructField("head", ArrayType(LongType()))]
    least = smallest_linked(percent)

    def make():
        def run(batch: pa.RecordBatch) -> list:
            out = [[], [], [], []]
            for value in batch.column("text"):
                tokens = shingles(value.as_py(), words)
                n = len(tokens)
                length = n - needed(n, percent) + most(n) if least and n >= least else 0
                for column, v in zip(out, (n, *set_key(tokens), tokens[:length].view(np.int64)), strict=True):
                    column.append(v)
            return out

        return run

    return extend(rows, fields, make, ["doc", "h"])


def slices(tokens: DataFrame) -> list[DataFrame]:
    """`tokens` in parts, by token."""
    return [tokens.where(F.pmod("token", F.lit(SLICES)) == k) for k in range(SLICES)]


def shared(posts: DataFrame) -> DataFrame:
    """The rows of `posts` whose token another row has, with the `size` of its list."""
    return posts.join(posts.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "token")


def screened(prefixes: DataFrame, percent: int) -> DataFrame:
    """(id, token, n, at) of `prefixes` (id, n, head): the tokens that another document has, of documents that have enough of them.

    In its longest prefix a document shares with any partner at least what the
    smallest possible partner asks for.
    """
    posts = prefixes.select("id", "n", F.posexplode("head").alias("at", "token"))
    parts = [staged(shared(part).drop("size"), "met") for part in slices(posts)]
    met = reduce(DataFrame.union, parts)
    asked = 1 + F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) / SHARE)
    able = met.groupBy("id").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= asked)
    out = staged(met.join(able.select("id"), "id"), "able")
    discard(*parts)
    return out


def fitted(posts: DataFrame, percent: int) -> DataFrame:
    """`posts` cut to each document's own prefix, with its `l`.

    The estimated cost of l is what the lists of its prefix hold, which is read,
    and that over l, which bounds the documents met l times, each verified by reading a
    set. A document whose cheapest prefix meets nobody has no partner and goes.
    """
    lists = posts.groupBy("token").agg((F.count("*") - 1).alias("others"))
    per_doc = posts.join(lists, "token").groupBy("id").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "others"))).alias("lists"))

    def make():
        def run(batch: pa.RecordBatch) -> list:
            chosen, cut = [], []
            for n, lists in zip(batch.column("n").to_pylist(), batch.column("lists"), strict=True):
                at = lists.values.field("at").to_numpy()
                reads = np.concatenate([[0], np.cumsum(lists.values.field("others").to_numpy())])
                levels = np.arange(1, most(n) + 1)
                ends = n - needed(n, percent) + levels
                held = reads[np.searchsorted(at, ends)]
                k = int(np.argmin(held + n * (held / levels)))
                chosen.append(int(levels[k]))
                cut.append(int(ends[k]) if held[k] else 0)
            return [chosen, cut]

        return run

    levels = extend(per_doc, [StructField("l", LongType()), StructField("cut", LongType())], make, ["id"])
    return posts.join(levels, "id").where("at < cut").drop("at", "cut")


def token_sets(docs: DataFrame, nodes: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(id, tokens): the whole set of each of `nodes` (id, doc, h), made from the text of document `doc` with digest `h`.

    Texts are dealt out once, and repeated rows go where they meet; sets are made behind that and not dealt.
    """
    chosen = texts(docs, text).join(nodes.select("id", "doc", "h"), ["doc", "h"]).dropDuplicates(["doc", "h"])

    def make():
        return lambda batch: [[shingles(v.as_py(), words).view(np.int64) for v in batch.column("text")]]

    return extend(chosen.select("id", "text"), [StructField("tokens", ArrayType(LongType()))], make, ["id"])


def partnered(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `sets` (id, tokens) without those that have more tokens of their own than any partner may lack.

    All tokens are looked at, not those of the prefix only. Passages that many documents share make a family
    of what has no partner in it; most of such documents go here.
    """
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    parts = []
    for part in slices(tokens):
        own = part.groupBy("token").agg(F.count("*").alias("size"), F.min("id").alias("id")).where("size = 1")
        parts.append(staged(own.groupBy("id").agg(F.count("*").alias("own")), "own"))
    own = reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("own").alias("own"))
    n = F.size("tokens")
    lone = sets.select("id", (n - F.ceil(F.lit(percent) * n / 100)).alias("may_lack")).join(own, "id").where("own > may_lack")
    out = staged(sets.join(lone.select("id"), "id", "left_anti"), "sets")
    discard(*parts)
    return out


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(id, token): of each of `sets` (id, tokens) so many tokens that any partner has one of them, those that the fewest sets have.

    Tokens without another set come first of all, but meet nobody.
    """
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    parts = [staged(shared(part), "ranked") for part in slices(tokens)]
    met = reduce(DataFrame.union, parts).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("size", "token"))).alias("met"))
    asked = F.ceil(F.lit(percent) * F.size("tokens") / 100).cast("int")
    both = met.join(sets.select("id", asked.alias("asked")), "id").where(F.size("met") >= F.col("asked"))
    out = staged(both.select("id", F.explode(F.slice(F.col("met.token"), F.lit(1), F.size("met") - F.col("asked") + 1)).alias("token")), "rare")
    discard(*parts)
    return out


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def pivots(members: DataFrame) -> DataFrame:
    """(token, p, pn): of each list the document whose lists are the fullest; a family's original, as its tokens are all shared."""
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("id")).alias("id"), "n")).alias("m")
    return members.join(weights, "id").groupBy("token").agg(best).select("token", (-F.col("m.id")).alias("p"), F.col("m.n").alias("pn"))


def joined(posts: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """(node, component) of linked sets; `posts` (id, n, l, token) are the fitted prefixes of `nodes`.

    Sets that are too much their own go first. Then each list compares its members with its pivot, and most families are one
    component at the cost of about one comparison a member. Lists whose other
    members are still in several components are joined in blocks.
    """
    able = shared(posts).select("id").distinct()
    whole = staged(token_sets(docs, nodes.join(able, "id", "left_semi"), words, text), "whole")
    sets = partnered(whole, percent)
    discard(whole)
    members = staged(shared(posts.join(sets.select("id"), "id", "left_semi")), "members")
    leads = staged(pivots(members), "pivots")
    met = members.join(leads, "token").where((F.col("id") != F.col("p")) & close_sizes(F.col("n"), F.col("pn"), percent))
    pairs = met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    found = staged(similar(pairs, sets, percent), "links")
    label = staged(components(found), "labels")

    named = members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = named.join(leads, "token").where(F.col("id") != F.col("p"))
    mixed = rest.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    left = rest.join(mixed.select("token"), "token").groupBy("id").agg(*(F.max(c).alias(c) for c in ("n", "l", "component")))
    left = staged(left, "mixed")
    discard(members, leads)
    more = staged(across(left, sets, percent), "links")
    discard(sets, left)
    if more.isEmpty():
        return label
    return staged(components(found.union(more)), "labels")


def across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components of `nodes` (id, n, l, component), one at least for each two that have any.

    Two sets that are linked share one of the tokens that are the rarest in each. A family is what lists of these
    over several components hold together, and falls into cells by size (sets two
    classes of size apart are too unlike). A cell's documents are dealt by hash into blocks, as
    many to a block as its largest allow; a task holds one pair of blocks, counts the
    prefix tokens that two documents share, and verifies on whole sets those that share
    enough. Pairs don't leave the task, links do. Documents of a family's largest component
    are not compared with each other. Pairs of blocks are dealt in rounds, each about as large as all the sets,
    so what lies on disk at once doesn't grow with the number of pairs.
    """
    chosen = staged(sets.join(nodes.select("id"), "id", "left_semi"), "chosen")
    rare = rarest(chosen, percent)
    posts = rare.join(nodes.select("id", "component"), "id")
    lists = posts.groupBy("token").agg(F.min("id").alias("b"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    edges = staged(posts.join(lists.select("token", "b"), "token").select(F.col("id").alias("a"), "b").distinct(), "met")
    discard(rare)
    family = staged(components(edges).toDF("id", "family"), "families")
    own = nodes.join(family, "id")
    own = staged(own.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent))), "own")
    parts = own.groupBy("family", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("family").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    spots = own.join(main.drop("parts"), "family").withColumns({"outer": F.col("component") != F.col("main"), "h": F.xxhash64(F.lit(13), "id")})
    blocks = F.ceil(F.count("*") / F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(BLOCK_TOKENS / F.max("n")))))
    # A cell has the outer documents of one size down its side; along its top those of that size and the next, and the main component's of all three.
    cell = ["family", "cell"]
    side = spots.where("outer").withColumn("cell", F.col("size"))
    rows = side.groupBy(*cell).agg(blocks.alias("rows"))
    sizes = F.when(F.col("outer"), F.array(F.col("size") - 1, F.col("size"))).otherwise(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    top = spots.withColumn("cell", F.explode(sizes)).join(rows, cell)
    columns = top.groupBy(*cell).agg(blocks.alias("columns"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own_columns = ["id", "n", "l", "component"]
    down = side.join(rows, cell).join(columns, cell).select(
        *cell, F.lit(0).alias("side"), F.pmod("h", "rows").alias("i"), span("columns").alias("j"), *own_columns)
    over = top.join(columns, cell).select(*cell, F.lit(1).alias("side"), span("rows").alias("i"), F.pmod("h", "columns").alias("j"), *own_columns)
    place = [*cell, "i", "j"]
    places = down.unionByName(over)
    held = chosen.agg(F.sum(F.size("tokens"))).first()[0] or 0
    rounds = max(1, math.ceil((places.agg(F.sum("n")).first()[0] or 0) / max(1, held)))
    fields = [StructField("a", LongType()), StructField("b", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def give():
            pairs = block_links(*held, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            small = [batch.column(c).to_pylist() for c in (*place, "side", "id", "l", "component")]
            tokens = batch.column("tokens")
            for at, (*here, side, ident, level, component) in enumerate(zip(*small, strict=True)):
                if here != key:
                    if held[0] and held[1]:
                        yield give()
                    key, held = here, ([], [])
                held[side].append((ident, level, component, tokens[at].values.to_numpy(zero_copy_only=False)))
        if held[0] and held[1]:
            yield give()

    found = []
    for k in range(rounds):
        now = places.where(F.pmod(F.xxhash64(F.lit(17), *place), F.lit(rounds)) == k).join(chosen, "id")
        found.append(staged(map_rows(now.repartition(*place).sortWithinPartitions(*place, "side", "id"), run, fields), "links"))
    discard(chosen)
    return reduce(DataFrame.union, found).distinct()


def block_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Linked pairs of two blocks of (id, l, component, tokens), one for each two components."""
    rows = left + right
    total, level, part = (np.array(v, dtype=np.int64) for v in ([len(r[3]) for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
    sizes = total - needed(total, percent) + level
    _, place, seen = np.unique(np.concatenate([r[3][:k] for r, k in zip(rows, sizes.tolist(), strict=True)]), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(rows)), sizes), seen[place] > 1
    place, owner = (np.cumsum(seen > 1) - 1)[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 1024
    for at in range(0, int((seen > 1).sum()), step):
        low, high = np.searchsorted(place, (at, at + step))
        some = np.zeros((len(rows), step), dtype=np.float32)
        some[owner[low:high], place[low:high] - at] = 1
        common += some[:len(left)] @ some[len(left):].T
    # The set whose prefix ends first has all but (its size - overlap) of that prefix in the other's prefix.
    slack = (level - needed(total, percent)).astype(np.float32)
    overlap = np.ceil(percent * (total[:len(left), None] + total[None, len(left):]) / (100 + percent) - 1e-9)
    enough = common >= overlap + np.minimum(slack[:len(left), None], slack[None, len(left):])
    del overlap
    enough &= part[:len(left), None] != part[None, len(left):]
    found, root = [], {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(enough), strict=True):
        (a, _, ca, x), (b, _, cb, y) = left[i], right[j]
        ca, cb = find(ca), find(cb)
        if ca == cb or min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both * 100 >= (len(x) + len(y) - both) * percent:
            found.append((min(a, b), max(a, b)))
            root[max(ca, cb)] = min(ca, cb)
    return found


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs`.

    Two documents are linked when their sets of distinct `words`-word shingles have
    100 * intersection >= percent * union; component_id is the smallest doc_id that
    links reach, the row's own included.

    A text without words has no shingles and no links; one with fewer words than a
    shingle is a single shingle. Equal sets are one node whatever the number of copies.
    Rows without doc_id count as one document that sorts first, and get a null
    component_id when it is their own; rows that share a doc_id with different texts are
    judged each by its own text. Very long texts are read whole. An empty table gives an
    empty result; other columns are not looked at.
    """
    full = staged(heads(docs, words, percent, text), "heads")
    rows = staged(full.drop("head"), "rows")
    sets = rows.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("doc", "h")).alias("least"), F.count("*").alias("copies"))
    sets = staged(sets.select("a", "b", "least.*", "copies"), "sets")
    # A set goes by its smallest doc_id, but for further sets of one doc_id, which get numbers of their own.
    firsts = sets.groupBy("doc").agg(F.min(F.struct("a", "b")).alias("first"))
    own = F.when(F.struct("a", "b") == F.col("first"), F.col("doc")).otherwise(-1 - F.pmod(F.xxhash64("a", "b"), F.lit(2 ** 62)))
    nodes = staged(sets.join(firsts, "doc").select(own.alias("id"), "doc", "h", "a", "b", "copies"), "nodes")
    prefixes = full.where(F.size("head") > 0).drop("h").join(nodes.drop("h"), ["doc", "a", "b"]).dropDuplicates(["doc", "a", "b"])
    prefixes = staged(prefixes.select("id", "n", "head"), "prefixes")
    discard(full)
    able = screened(prefixes, percent)
    discard(prefixes)
    posts = staged(fitted(able, percent), "fitted")
    discard(able)
    linked = staged(joined(posts, nodes.drop("copies"), docs, words, percent, text), "linked")
    discard(posts)
    named = nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc").alias("smallest"))
    classes = staged(named.join(least, "component").select("a", "b", "smallest", "copies"), "classes")
    full = two_way_join(rows.where("n > 0").select("doc", "n", "a", "b"), classes, ["a", "b"], "copies")
    out = full.select("doc", "n", "smallest").union(rows.where("n = 0").select("doc", "n", F.col("doc").alias("smallest")))
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(plain("doc").alias("doc_id"), F.col("n").alias("n_shingles"), plain("smallest").alias("component_id"))
