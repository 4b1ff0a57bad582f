"""Near-duplicate documents by HyperMinHash sketches.

A sketch has 128 registers. Each keeps, of the smallest hash that fell into it,
the number of leading zeros and ten mantissa bits: 16 bits in all. Four
registers are a band of 64 bits. Documents that share a band are candidates;
their estimated similarity is corrected for registers that agree by chance;
what remains is verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from fleetlens.llm.common import NO_ID, extend, map_rows, quoted, two_way_join
from fleetlens.llm.components import components
from fleetlens.session import staged

REGISTERS, BANDS, MANTISSA = 128, 32, 10
TAIL = 57  # bits of a hash below those that choose the register
#: Candidates are dropped by their estimate only when it is this many standard errors short.
ERRORS = 5.0#: Sets in a block when the members of a family are compared with each other.
BLOCK = 256

#: The order in which an empty register asks the others for a value.
PROBES = np.argsort(np.random.default_rng(20240229).random((REGISTERS, REGISTERS)), axis=1)
KEY = ["_llm_band", "_llm_key"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are what lies between ASCII white space after A-Z went to lower case. A
    text with fewer words than a shingle is one shingle; without words, none.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    size = min(words, len(parts))
    one = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), dtype=np.uint64)
    n = len(one) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for at in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + one[at:at + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a non-empty sorted hash set; empty ones borrow from a register chosen at random."""
    bucket = (hashes >> np.uint64(TAIL)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    tail = (hashes[first] & np.uint64((1 << TAIL) - 1)).astype(np.float64)
    share, power = np.frexp(tail)
    mantissa = np.minimum((share - 0.5) * (2 << MANTISSA), (1 << MANTISSA) - 1).clip(0).astype(np.int64)
    value = np.zeros(REGISTERS, dtype=np.uint16)
    full = np.zeros(REGISTERS, dtype=bool)
    full[bucket[first]] = True
    value[bucket[first]] = ((TAIL - power).clip(0, 63) << MANTISSA | mantissa).astype(np.uint16)
    source = np.where(full, np.arange(REGISTERS), PROBES[np.arange(REGISTERS), np.argmax(full[PROBES], axis=1)])
    return value[source]


def sketches(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(_llm_id, n_shingles, _llm_a, _llm_b, _llm_bands) per row: set size, a 128-bit key of the set, and its bands."""
    ids = docs.select(F.coalesce(quoted("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_llm_id"), quoted(text).alias("_llm_text"))
    fields = [StructField("n_shingles", LongType()), StructField("a", LongType()), StructField("b", LongType()),
              StructField("bands", ArrayType(LongType()))]

    def make():
        def run(batch: pa.RecordBatch) -> list:
            sizes, left, right, bands = [], [], [], []
            for value in batch.column("text"):
                hashes = shingles(value.as_py(), words)
                sizes.append(len(hashes))
                if not len(hashes):
                    left.append(None), right.append(None), bands.append(None)
                    continue
                a, b = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), dtype=np.int64)
                left.append(int(a)), right.append(int(b)), bands.append(sketch(hashes).view(np.int64))
            return [sizes, left, right, bands]

        return run

    out = extend(ids.toDF("id", "text"), fields, make, ["id"])
    return out.toDF("_llm_id", "n_shingles", "_llm_a", "_llm_b", "_llm_bands")


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave a similarity of `percent` possible.

    Two registers agree by chance about once in 2**10, more often when few leading
    zeros occur: with agreement m and chance c the estimate is (m - c) / (1 - c). A
    set with fewer shingles than registers has fewer independent registers, which
    widens the margin.
    """
    side = lambda name: nodes.select(F.col("_llm_id").alias(name), F.col("_llm_bands").alias(f"s{name}"),
                                     F.col("n_shingles").alias(f"n{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def make():
        def run(batch: pa.RecordBatch) -> list:
            if not batch.num_rows:
                return [[]]
            wide = [np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)).view(np.uint16).reshape(-1, REGISTERS)
                    for c in ("sa", "sb")]
            m = (wide[0] == wide[1]).mean(axis=1)
            least = np.minimum(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")]).astype(np.float64)
            chance = 0.5 ** MANTISSA
            j = (m - chance) / (1 - chance)
            limit = percent / 100
            error = np.sqrt(limit * (1 - limit) / np.minimum(least, REGISTERS))
            return [[bool(x) for x in j >= limit - ERRORS * error]]

        return run

    from pyspark.sql.types import BooleanType

    return extend(both, [StructField("near", BooleanType())], make, ["a", "b", "near"], 4096).where("near").select("a", "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(id, hashes) with the full shingle set of each document in `wanted` (_llm_id); only those are made."""
    rows = docs.select(F.coalesce(quoted("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_llm_id"), quoted(text).alias("text"))

    def make():
        return lambda batch: [[shingles(v.as_py(), words).view(np.int64) for v in batch.column("text")]]

    sets = extend(rows.join(wanted, "_llm_id", "left_semi").select(F.col("_llm_id").alias("id"), "text"),
                  [StructField("hashes", ArrayType(LongType()))], make, ["id", "hashes"])
    return sets.dropDuplicates(["id", "hashes"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(common * 100 >= union * percent).select("a", "b").distinct()


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(nodes: DataFrame, docs: DataFrame, words: int, percent: int, text: str = "text") -> DataFrame | None:
    """(_llm_id, component) of the sets that are linked to others, directly or through others; None when nothing is.

    First each bucket (the sets that share a band) compares all its members with
    one: the member whose buckets are the fullest, which in a family of edited copies
    is the original. Most families become one component that way, at about one
    comparison a member. What buckets then still hold in several components is thinned
    out exactly: a link needs `percent` of a set's shingles in the other one, so a set
    that shares fewer with all other components together has no link left to find.
    The rest is compared block by block in `links_across`.
    """
    bands = nodes.select("_llm_id", "n_shingles", F.posexplode("_llm_bands").alias(*KEY))
    buckets = bands.groupBy(*KEY).agg(F.count("*").alias("size")).where("size > 1")
    members = staged(bands.join(buckets, KEY), "members")
    weights = members.groupBy("_llm_id").agg(F.sum("size").alias("weight"))
    sets = staged(shingle_sets(docs, weights, words, text), "sets")
    best = F.max(F.struct("weight", (-F.col("_llm_id")).alias("id"), "n_shingles")).alias("m")
    pivots = members.join(weights, "_llm_id").groupBy(*KEY).agg(best).select(
        *KEY, (-F.col("m.id")).alias("p"), F.col("m.n_shingles").alias("pn"))
    met = members.join(pivots, KEY).where(
        (F.col("p") != F.col("_llm_id")) & similar_sizes(F.col("pn"), F.col("n_shingles"), percent))
    near = staged(estimated(met.select(*_pair("p", "_llm_id")).distinct(), nodes, percent), "near")
    found = staged(verified(near, sets, percent), "links")
    label = staged(components(found), "labels").withColumnRenamed("node", "_llm_id")

    named = members.join(label, "_llm_id", "left").withColumn("component", F.coalesce("component", "_llm_id"))
    mixed = named.groupBy(*KEY).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    left = staged(named.join(mixed.select(*KEY), KEY), "open")
    parts = left.select(F.col("_llm_id").alias("id"), "component").distinct().join(sets, "id").select(
        "id", "component", F.explode("hashes").alias("h"))
    across = parts.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    shared = parts.join(across, "h").groupBy(F.col("id").alias("_llm_id")).agg(F.count("*").alias("common"))
    left = staged(left.join(shared, "_llm_id").where(F.col("common") * 100 >= F.col("n_shingles") * percent), "open")
    more = staged(links_across(left, sets, percent), "links")
    if more.limit(1).count():
        return staged(components(found.union(more)), "labels").withColumnRenamed("node", "_llm_id")
    return label


def links_across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components of one family, one at least for each two components that have any.

    A family is what buckets hold together. Its members outside its largest component
    are compared with all others on the full sets, so nothing is missed that a bucket
    would have shown. They meet in blocks of BLOCK by BLOCK sets: a task holds one
    pair of blocks, and gives out links, never pairs.
    """
    first = members.groupBy(*KEY).agg(F.min("_llm_id").alias("b"))
    family = staged(components(members.join(first, KEY).select(F.col("_llm_id").alias("a"), "b")).toDF("id", "family"), "families")
    own = members.select(F.col("_llm_id").alias("id"), "component").distinct().join(family, "id")
    parts = own.groupBy("family", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("all"),
                                        (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    spots = own.join(sizes, "family").withColumns({
        "rows": F.ceil(F.col("rest") / BLOCK), "columns": F.ceil(F.col("all") / BLOCK), "h": F.xxhash64(F.lit(3), "id")})
    spots = spots.withColumns({"i": F.pmod("h", "rows"), "j": F.pmod("h", "columns")})
    span = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    down = spots.where("component <> main").withColumn("side", F.lit(0)).withColumn("j", F.explode(span("columns")))
    over = spots.withColumn("side", F.lit(1)).withColumn("i", F.explode(span("rows")))
    dealt = down.unionByName(over).join(sets, "id").select("family", "i", "j", "side", "id", "component", "hashes")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "id")

    def run(batches):
        key, held = None, []

        def give():
            a, b = _linked([h for h in held if not h[0]], [h for h in held if h[0]], percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            wide = [batch.column(c).to_pylist() for c in ("family", "i", "j", "side", "id", "component")]
            hashes = batch.column("hashes")
            for at, (f, i, j, side, ident, component) in enumerate(zip(*wide, strict=True)):
                if (f, i, j) != key:
                    if held:
                        yield give()
                    key, held = (f, i, j), []
                held.append((side, ident, component, hashes[at].values.to_numpy(zero_copy_only=False)))
        if held:
            yield give()

    return map_rows(dealt, run, [StructField("a", LongType()), StructField("b", LongType())]).distinct()


def _linked(left: list[tuple], right: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Pairs of ids of two blocks that are linked, one for each two components."""
    if not left or not right:
        return [], []
    rows = left + right
    sizes = np.array([len(r[3]) for r in rows])
    tokens, place, seen = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(tokens), 4096):
        low, high = np.searchsorted(place, (at, at + 4096))
        some = np.zeros((len(rows), 4096), dtype=np.float32)
        some[owner[low:high], place[low:high] - at] = 1
        some = some[:, seen[at:at + 4096].nonzero()[0]]
        common += some[:len(left)] @ some[len(left):].T
    both = common.astype(np.int64)
    union = sizes[:len(left), None] + sizes[None, len(left):] - both
    parts = np.array([r[2] for r in rows])
    linked = (both * 100 >= union * percent) & (parts[:len(left), None] != parts[None, len(left):])
    chosen = {}
    for x, y in zip(*np.nonzero(linked), strict=True):
        chosen.setdefault(tuple(sorted((left[x][2], right[y][2]))), (left[x][1], right[y][1]))
    pairs = sorted((min(p), max(p)) for p in chosen.values())
    return [a for a, _ in pairs], [b for _, b in pairs]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`.

    Two documents are linked when their sets of distinct `words`-word shingles have
    100 * intersection >= percent * union. component_id is the smallest doc_id that
    links reach, kept tells whether it is the row's own.

    A text without words has no shingles and no links; one with fewer words than a
    shingle is a single shingle. Equal sets are one node whatever the number of
    copies, so thousands of copies cost one sketch each and nothing more. Rows
    without doc_id count as one document that sorts first, and get a null
    component_id when it is their own; rows that share a doc_id with different texts
    are judged each by its own text, and share their links when that id is the
    smallest with both. Very long texts are shingled whole. The other columns
    of `docs` are not looked at.
    """
    rows = staged(sketches(docs, words, text), "sketches")
    classes = staged(rows.where("n_shingles > 0").groupBy("_llm_a", "_llm_b").agg(
        F.min("_llm_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # The smallest set that can be linked to another one: n / (n + 1) must reach the limit.
    smallest = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else None
    if smallest is None:
        linked = None
    else:
        reps = rows.where(F.col("n_shingles") >= smallest).join(
            classes.select(F.col("rep").alias("_llm_id"), "_llm_a", "_llm_b"), ["_llm_id", "_llm_a", "_llm_b"], "left_semi")
        nodes = staged(reps.dropDuplicates(["_llm_id", "_llm_a", "_llm_b"]), "nodes")
        linked = links(nodes, docs, words, percent, text)
    named = classes.withColumn("component", F.col("rep"))
    if linked is not None:
        named = classes.join(linked.withColumnRenamed("_llm_id", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))
    named = staged(named.select("_llm_a", "_llm_b", "component", "copies"), "classes")
    full = two_way_join(rows.where("n_shingles > 0").drop("_llm_bands"), named, ["_llm_a", "_llm_b"], "copies")
    out = full.select("_llm_id", "n_shingles", "component").union(
        rows.where("n_shingles = 0").select("_llm_id", "n_shingles", F.col("_llm_id").alias("component")))
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(plain("_llm_id").alias("doc_id"), "n_shingles", plain("component").alias("component_id"),
                      (F.col("_llm_id") == F.col("component")).alias("kept"))
