"""Block markup: comments that open, close or are a block, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.operators.brackets import paired
from fleetlens.operators.parts import dealt, tasks
from fleetlens.session import staged

# The grammar of a block comment (closer, name, attributes, self-closing).
BLOCK = r"(?s)<!--\s+(/?)wp:([a-z][a-z0-9_-]*(?:/[a-z][a-z0-9_-]*)?)(?:\s+(\{.*?\}))?\s+(/?)-->"
#: Blocks without a namespace belong to this one.
CORE = "core/"


def _full(name: Column) -> Column:
    return F.when(name.contains("/"), name).otherwise(F.concat(F.lit(CORE), name))


def block_tokens(docs: DataFrame, key: str, markup: str = "markup") -> DataFrame:
    """(key, at, name, step, attrs) of every block comment in order; attrs is null when there are none."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(markup, F.lit(BLOCK), F.lit(0))).alias("at", "token"))
    part = lambda k: F.regexp_extract("token", BLOCK, k)
    step = F.when(part(1) == "/", -1).when(part(4) == "/", 0).otherwise(1)
    return found.select(key, "at", _full(part(2)).alias("name"), step.alias("step"), F.nullif(part(3), F.lit("")).alias("attrs"))


def _paired(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """The block comments of `docs`, paired; they are dealt out by their number, as every step sorts what a task has of them."""
    tokens = staged(block_tokens(docs, key, markup), "tokens")
    return paired(dealt(tokens, tasks(tokens, tokens.count()), key), key)


def blocks(docs: DataFrame, key: str, markup: str = "markup") -> DataFrame:
    """(key, at, name, depth, parent, closed, attrs) of every block.

    depth counts the open blocks around it and parent names the innermost: the last
    one opened a level above. A self-closing block is closed; an opener without a closer
    is not. Null markup has no blocks.
    """
    found = _paired(docs, key, markup).where("step >= 0")
    own = found.select(key, "at", "name", "level", "attrs", F.col("level").alias("_row"), F.lit(None).cast("string").alias("_opened"),
                       ((F.col("step") == 0) | F.col("partner").isNotNull()).alias("closed"))
    # A block reads the openers one level up: they are listed there under their own level.
    marks = found.where("step = 1").select(key, "at", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("level"),
                                           F.lit(None).cast("string").alias("attrs"), (F.col("level") + 1).alias("_row"),
                                           F.col("name").alias("_opened"), F.lit(None).cast("boolean").alias("closed"))
    above = Window.partitionBy(key, "_row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.unionByName(marks).withColumn("parent", F.last("_opened", ignorenulls=True).over(above))
    return rows.where(F.col("name").isNotNull()).select(
        key, "at", "name", F.col("level").cast("int").alias("depth"), "parent", "closed", "attrs")


def census(found: DataFrame) -> DataFrame:
    """(name, depth, parent, n) over all blocks."""
    return found.groupBy("name", "depth", "parent").agg(F.count("*").alias("n"))


def block_errors(docs: DataFrame, key: str, markup: str = "markup") -> DataFrame:
    """(key, at, rule, name, opened): what keeps markup from being well formed.

    unbalanced_closer: nothing is open; mismatched_closer: `opened` is what it ends;
    unclosed_block: no closer follows; invalid_attributes: not JSON.
    """
    found = _paired(docs, key, markup)
    beside = Window.partitionBy(key, "level", (F.col("stray") | (F.col("step") == 0))).orderBy("at")
    found = found.withColumn("opened", F.when((F.col("step") == -1) & ~F.col("stray"), F.lag("name").over(beside)))
    rules = F.array_compact(F.array(
        F.when(F.col("stray"), F.lit("unbalanced_closer")),
        F.when(F.col("opened") != F.col("name"), F.lit("mismatched_closer")),
        F.when((F.col("step") == 1) & F.col("partner").isNull(), F.lit("unclosed_block")),
        F.when(F.col("attrs").isNotNull() & (F.col("step") >= 0) & F.try_parse_json("attrs").isNull(), F.lit("invalid_attributes"))))
    each = found.withColumn("rule", F.explode(rules))
    return each.select(key, "at", "rule", "name", F.when(F.col("rule") == "mismatched_closer", F.col("opened")).alias("opened"))
