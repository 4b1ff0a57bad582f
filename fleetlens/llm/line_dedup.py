"""Lines that many documents share are kept in one of them only. DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import NO_ID, SPACES, carried, let, lower_ascii, quoted, two_way_join
from fleetlens.session import staged

KEY = ["_llm_a", "_llm_b"]
DOC = ["_llm_id", "_llm_text"]


def _without(lines: Column, dropped: Column) -> Column:
    """The lines whose positions are not in `dropped` (ascending): the runs between two dropped ones."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    runs = F.zip_with(before, after, lambda a, b: F.slice(lines, a + F.lit(2), b - a - F.lit(1)))
    return F.array_join(F.flatten(runs), "\n")


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(long lines with document, position and 128-bit key; keys that enough documents hold), both staged.

    Counting goes through (key, document) first and key second, so a line that
    every document holds is counted in parts.
    """
    text = F.coalesce(quoted("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(quoted("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_llm_id"), F.xxhash64(text).alias("_llm_text"),
        F.posexplode(F.split(text, "\n", -1)).alias("_llm_pos", "_llm_line"))
    core = F.btrim(F.col("_llm_line"), F.lit(SPACES))
    key = lower_ascii(core)
    pairs = staged(lines.where(F.char_length(core) >= min_chars).select(
        *DOC, "_llm_pos", F.xxhash64(key).alias("_llm_a"), F.xxhash64(F.lit(1), key).alias("_llm_b")), "lines")
    keys = pairs.groupBy(*KEY).agg(F.count_distinct("_llm_id").alias("_llm_docs"), F.max("_llm_id").alias("_llm_last"))
    return pairs, staged(keys.where(F.col("_llm_docs") >= min_docs), "line-keys")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with shared lines cut out of `text`, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case.
    A key of at least `min_chars` code points that at least `min_docs` documents
    hold loses all its lines except those of the largest doc_id that holds it,
    where every repeat stays. Keys are compared by 128 bits of hash.

    Null text counts as empty, and empty text as one empty line; both give ''.
    Rows without doc_id are one document that sorts before all others. Rows that
    share a doc_id are one document when documents are counted, and each is
    rewritten on its own; repeated rows come out as often as they went in.
    Input columns n_lines and n_dropped are replaced, others are handed on.
    """
    pairs, keys = shared_lines(docs, min_chars, min_docs)
    hits = two_way_join(pairs, keys, KEY, "_llm_docs").where(F.col("_llm_id") < F.col("_llm_last"))
    drops = hits.groupBy(*DOC).agg(F.array_sort(F.collect_set("_llm_pos")).alias("_llm_drop"))
    text = F.coalesce(quoted("text"), F.lit(""))
    rows = docs.select(
        *[quoted(c) for c in carried(docs, ("text", "n_lines", "n_dropped"))], text.alias("text"),
        F.coalesce(quoted("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_llm_id"), F.xxhash64(text).alias("_llm_text"))
    joined = rows.join(drops, DOC, "left")
    clean = F.when(F.col("_llm_drop").isNull(), F.col("text")).otherwise(
        let(F.split("text", "\n", -1), lambda lines: _without(lines, F.col("_llm_drop"))))
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return joined.select(
        *[clean.alias("text") if c.lower() == "text" else quoted(c) for c in carried(docs, ("n_lines", "n_dropped"))],
        (breaks + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_llm_drop"), F.lit(0)).cast("bigint").alias("n_dropped"))
