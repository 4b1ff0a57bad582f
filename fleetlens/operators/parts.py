"""How many tasks a step is dealt to: by its rows, since with a fixed number what a task holds grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task gets.
ROWS = 200_000


def tasks(df: DataFrame, rows: int, each: int | None = None) -> int | None:
    """The tasks that `rows` need, `each` (or ROWS) to a task, if a shuffle of `df` has fewer by itself."""
    n = -(-rows // (each or ROWS))
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to `n` tasks, or to as many as a shuffle has."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)
