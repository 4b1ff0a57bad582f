"""Nested JSON: JSON-LD nodes, string search by path, tile layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.duplicates import duplicate_members
from fleetlens.operators.intervals import outside_intervals
from fleetlens.operators.ordered import ordered_scan
from fleetlens.operators.skew import lookup
from fleetlens.session import staged

def json_values(docs: DataFrame, keys: list[str], node: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(every value of the JSON in `text`, the rows whose text can't be read), each with `keys`.

    A value has its place (positions from the root down; places in array order are
    document order), its path as a.b[0].c, its kind (object, array, string or other)
    and itself as a variant. `node` says which values are nodes; `above` is the place
    of the nearest node over a value, and what an @graph holds has none. Documents
    are opened level by level, so depth costs rounds and never a call stack.
    """
    parsed = staged(docs.select(*keys, "text", F.try_parse_json("text").alias("value")), "json")
    broken = parsed.where("value IS NULL AND text IS NOT NULL").drop("value")
    kind = F.regexp_extract(F.lower(F.schema_of_variant("value")), r"^(object|array|string)", 1)
    named = lambda df: df.withColumn("kind", kind).withColumn("is_node", F.lit(False) if node is None else node)
    level = named(parsed.where("value IS NOT NULL").select(
        *keys, F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("array<int>").alias("above"), "value"))
    whole = None
    while True:
        level = staged(level, "json-level")
        whole = level if whole is None else whole.unionByName(level)
        inner = level.where("kind IN ('object', 'array')")
        if not inner.limit(1).count():
            return whole, broken
        children = docs.sparkSession.sql("SELECT p.*, c.pos, c.key, c.value AS child FROM {p} p, LATERAL variant_explode(p.value) c", p=inner)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(
            F.concat(F.lit("."), "key"))
        above = F.when(F.col("key") == "@graph", F.lit(None)).when(F.col("is_node"), F.col("place")).otherwise(F.col("above"))
        level = named(children.select(
            *keys, F.concat("place", F.array(F.col("pos").cast("int"))).alias("place"), F.concat("path", step).alias("path"),
            F.coalesce("key", "name").alias("name"), above.alias("above"), F.col("child").alias("value")))


def json_ld_nodes(blocks: DataFrame, old_domains: tuple[str, ...] = ()) -> DataFrame:
    """One row per structured-data node of (page, blocks array<string>); unreadable blocks give an error row.

    A node is an object without @graph that has a type or any property of its own.
    Nodes are numbered per page in document order; those without @id are called
    _:b_1, _:b_2 and so on. parent_id is the nearest node around one. `properties` is
    the object as it stands; nested nodes have rows of their own besides.
    """
    texts = blocks.select("page", F.posexplode("blocks").alias("block_index", "text")).where("text <> ''")
    names = F.json_object_keys(F.to_json("value"))
    own = F.size(F.array_except(names, F.array(*[F.lit(x) for x in ("@id", "@context", "@graph")]))) > 0
    node = F.coalesce((F.col("kind") == "object") & ~F.array_contains(names, "@graph") & own
                      & ~F.coalesce(F.col("name"), F.lit("")).isin("@context", "@id", "@type"), F.lit(False))
    values, broken = json_values(texts, ["page", "block_index"], node)
    at = ["page", "block_index", "place"]
    kinds = F.coalesce(F.try_variant_get("value", '$["@type"]', "array<string>"), F.array(F.try_variant_get("value", '$["@type"]', "string")))
    given = F.nullif(F.try_variant_get("value", '$["@id"]', "string"), F.lit(""))
    found = staged(values.where("is_node").select(
        *at, "above", given.alias("given"), F.filter(kinds, lambda k: k != "").alias("type"), F.to_json("value").alias("properties"),
        F.lit(1).cast("bigint").alias("one"), given.isNull().cast("bigint").alias("blank")), "nodes")
    numbered = ordered_scan(found, ["page"], ["block_index", "place"], sums={"number": "one", "blanks": "blank"})
    first = found.where("given IS NOT NULL").groupBy("page", "given").agg(F.min(F.struct("block_index", "place")).alias("first"))
    named = staged(numbered.join(first, ["page", "given"], "left").withColumn(
        "id", F.coalesce("given", F.concat(F.lit("_:b_"), "blanks"))), "nodes")
    text = F.lower("properties")
    mentioned = F.lit(False)
    for domain in old_domains:
        mentioned = mentioned | text.contains(domain.lower())
    problems = F.array_compact(F.array(
        F.when(F.col("first") != F.struct("block_index", "place"), F.lit("duplicate_id")),
        F.when(F.size("type") < 1, F.lit("missing_type")), F.when(mentioned, F.lit("old_domain_reference"))))
    parents = named.select("page", "block_index", F.col("place").alias("above"), F.col("id").alias("parent_id"))
    rows = named.join(parents, ["page", "block_index", "above"], "left").select(
        "page", F.col("block_index").cast("int").alias("block_index"), (F.col("number") - 1).cast("int").alias("node_index"), "id",
        F.when(F.size("type") > 0, F.col("type")).alias("type"), "parent_id", problems.alias("findings"), "properties",
        F.lit(None).cast("string").alias("error"))
    return rows.unionByName(broken.select("page", F.col("block_index").cast("int").alias("block_index"), F.lit("unreadable JSON").alias("error")),
                            allowMissingColumns=True)


def extraction_totals(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count_distinct("page").alias("pages"), F.count_if(F.col("error").isNull()).alias("nodes"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"))


def json_strings(docs: DataFrame) -> DataFrame:
    """(source, path, value) of every string in (source, text) JSON documents; path as a.b[0].c."""
    values, _ = json_values(docs, ["source"])
    return values.where("kind = 'string'").select("source", "path", F.variant_get("value", "$", "string").alias("value"))


# --- tile maps ------------------------------------------------------------------------------

FLIP_FLAGS = 0xF0000000


def clean_gid(raw: Column) -> Column:
    """Tile id without its flip flags."""
    return raw.bitwiseAND(F.lit(0xFFFFFFFF ^ FLIP_FLAGS).cast("bigint"))


def property_map(properties: Column) -> Column:
    """array<struct<name, value>> -> map; of equal names the last one stays."""
    keep = F.filter(properties, lambda p, i: ~F.exists(
        F.slice(properties, i + 2, F.size(properties)), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(F.transform(keep, lambda p: F.struct(p["name"], p["value"])))


def layer_issues(layers: DataFrame) -> DataFrame:
    """Size problems of (map, layer, width, height, map_width, map_height, data) tile layers."""
    c = F.col
    hits = F.array_compact(F.array(
        F.when((c("width") != c("map_width")) | (c("height") != c("map_height")), F.lit("dimension")),
        F.when(c("data").isNull(), F.lit("data_missing")),
        F.when(F.size("data") != F.coalesce(c("width") * c("height"), F.lit(0)), F.lit("data_size"))))
    return layers.select("map", "layer", F.explode(hits).alias("problem"))


def tile_cells(layers: DataFrame) -> DataFrame:
    """(map, layer, idx, x, y, gid, raw_gid) of the filled cells; chunks carry an offset in x0, y0."""
    width = F.greatest("width", F.lit(1))
    return layers.select("map", "layer", "x0", "y0", width.alias("w"), F.posexplode("data").alias("idx", "raw_gid")).select(
        "map", "layer", "idx", (F.col("x0") + F.col("idx") % F.col("w")).alias("x"), (F.col("y0") + F.floor(F.col("idx") / F.col("w"))).alias("y"),
        clean_gid(F.col("raw_gid")).alias("gid"), "raw_gid").where("gid <> 0")


def invalid_gids(cells: DataFrame, tilesets: DataFrame) -> DataFrame:
    """Cells whose gid no tileset (map, lo, hi) of their map holds."""
    ident = cells.withColumn("_id", F.concat_ws("|", "map", "layer", "idx"))
    return outside_intervals(ident, tilesets, "gid", "_id", ["map"]).drop("_id")


def missing_properties(objects: DataFrame, required: DataFrame) -> DataFrame:
    """Required (type, property) pairs that an object (id, type, properties map) lacks; type '*' means every object.

    The requirements come from a config file and ride along as one array per type.
    """
    per_type = required.groupBy("type").agg(F.collect_set("property").alias("need"))
    star = per_type.where("type = '*'").select("need").scalar()
    own = per_type.where("type <> '*'")
    joined = lookup(objects, own, "type", ["id"])
    none = F.array().cast("array<string>")
    need = F.concat(F.coalesce(star, none), F.coalesce("need", none))
    lacking = F.array_except(need, F.coalesce(F.map_keys("properties"), none))
    return joined.select("id", "type", F.explode(lacking).alias("property"))


def object_issues(objects: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Objects (map, uid, id, type) that repeat an id of their map, lack one, or have a type that is not allowed."""
    key = F.when(F.col("id").isNotNull(), F.concat_ws("|", "map", "id"))
    repeats = duplicate_members(objects, key, "uid").where("uid <> first_member").select("uid", F.lit("duplicate_id").alias("problem"))
    hits = F.array_compact(F.array(
        F.when(F.col("id").isNull(), F.lit("missing_id")),
        F.when(F.lit(allowed is not None) & ~F.coalesce(F.col("type").isin(allowed or []), F.lit(False)), F.lit("object_type"))))
    return repeats.unionByName(objects.select("uid", F.explode(hits).alias("problem")))


def missing_layers(maps: DataFrame, layers: DataFrame, required: list[str]) -> DataFrame:
    have = layers.groupBy("map").agg(F.collect_set(F.when(F.col("layer").isin(required), F.col("layer"))).alias("have"))
    none = F.array().cast("array<string>")
    want = F.array(*[F.lit(r) for r in required]) if required else none
    return maps.join(have, "map", "left").select("map", F.explode(F.array_except(want, F.coalesce("have", none))).alias("layer"))
