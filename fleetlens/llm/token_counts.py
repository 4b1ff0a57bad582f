"""Exact length histogram: documents by encoded length, and what any context limit makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.ordered import ordered_scan
from fleetlens.session import staged


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per distinct length with its suffix sums; empty for an empty table.

    n_docs           documents of this length
    docs_ge          documents at least as long
    tokens_ge        their tokens
    docs_le          documents at most as long
    share_le         the same as a share: the smallest length with share_le >= q is the q-quantile
    total_docs       all documents
    total_tokens     all tokens
    truncated_total  tokens left when every document is cut at this length

    Any other limit C lies between two lengths, and those at or above it are the
    same as for the next length L: the truncated total is
    total_tokens - tokens_ge(L) + C * docs_ge(L). Null lengths count as 0.
    The running sums go over slices of the length range, never over one task.
    """
    counts = lengths.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("n_tokens")).agg(
        F.count("*").alias("n_docs"))
    counts = staged(counts.withColumn("_llm_tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    scan = ordered_scan(counts, [], ["n_tokens"], sums={"docs_ge": "n_docs", "tokens_ge": "_llm_tokens"},
                        totals={"total_docs": "n_docs", "total_tokens": "_llm_tokens"}, reverse=True)
    le = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")
    return scan.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge", le.alias("docs_le"), (le / F.col("total_docs")).alias("share_le"),
        "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for each of a few limits, from the histogram's suffix sums."""
    picks = []
    for i, limit in enumerate(limits):
        above = F.col("n_tokens") > limit
        picks += [F.min_by(F.when(above, F.struct("docs_ge", "tokens_ge")), F.when(above, F.col("n_tokens"))).alias(f"_llm_{i}")]
    one = histogram.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("_llm_all"), *picks)
    rows = [F.struct(F.lit(limit).cast("bigint").alias("context_limit"),
                     F.coalesce(F.col(f"_llm_{i}.docs_ge"), F.lit(0)).alias("docs_over"),
                     (F.col("_llm_all") - F.coalesce(F.col(f"_llm_{i}.tokens_ge"), F.lit(0))
                      + F.coalesce(F.col(f"_llm_{i}.docs_ge"), F.lit(0)) * limit).alias("truncated_total"))
            for i, limit in enumerate(limits)]
    return one.select(F.inline(F.array(*rows)))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    one = histogram.agg(*[F.min(F.when(F.col("docs_le") >= F.ceil(F.col("total_docs") * F.lit(q)), F.col("n_tokens"))).alias(f"_llm_{i}")
                          for i, q in enumerate(shares)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(q).alias("share"), F.col(f"_llm_{i}").alias("n_tokens")) for i, q in enumerate(shares)])))
