"""Openers and closers matched without a stack: a running depth, and the next closer of the same depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def paired(tokens: DataFrame, *keys: str) -> DataFrame:
    """`tokens` (*keys, at, step) with level, stray and partner.

    step is 1 for an opener, -1 for a closer and 0 for what stands by itself. Within
    its keys and in the order of `at`, a closer ends the innermost open opener; one that
    meets none is stray and changes nothing. level is how many openers enclose a token;
    an opener and its closer have the same. partner is the other one's `at`, null
    for what is unclosed, stray or stands by itself. Keys are dealt out once: all three passes
    sort within them.
    """
    order = Window.partitionBy(*keys).orderBy("at")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    # The depth never falls below zero: what the running sum has fallen short by so far is added back.
    run = tokens.withColumn("_run", F.sum("step").over(past))
    run = run.withColumn("_low", F.least(F.lit(0), F.min("_run").over(past)))
    before = F.coalesce(F.lag("_low").over(order), F.lit(0))
    leveled = run.withColumns({"stray": (F.col("step") == -1) & (F.col("_low") < before),
                               "level": F.col("_run") - F.col("_low") - F.when(F.col("step") == 1, 1).otherwise(0)})
    beside = Window.partitionBy(*keys, "level", (F.col("stray") | (F.col("step") == 0))).orderBy("at")
    partner = F.when(F.col("stray"), F.lit(None)).when(F.col("step") == 1, F.lead("at").over(beside)).when(
        F.col("step") == -1, F.lag("at").over(beside))
    return leveled.withColumn("partner", partner).drop("_run", "_low")
