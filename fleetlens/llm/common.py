"""Helpers shared by the operators of this subpackage.

Column names that begin with `_llm_` are reserved for the operators; such a
column of an input is dropped. An output column replaces an input column of
the same name, whatever its case.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\t\n\x0b\f\r "
#: The stand-in for a missing id: rows without one count as one document that sorts first.
NO_ID = -(2 ** 63)
#: How many of the heaviest keys a skewed join answers from a broadcast.
HOT_KEYS = 1000


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def carried(df: DataFrame, new: Iterable[str]) -> list[str]:
    """The columns of `df` that an operator with the output columns `new` hands on."""
    taken = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in taken and not c.lower().startswith("_llm_")]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def two_way_join(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join with `dim` (one short row per key), whose heaviest keys may own a large share of `rows`.

    The HOT_KEYS keys with the largest `weight` (their number bounds the
    broadcast) are answered in place; the rows of all others are shuffled, and
    none of those keys can own more than 1 / HOT_KEYS of the weight. Both inputs
    should be staged: each is read twice.
    """
    hot = F.broadcast(dim.orderBy(F.col(weight).desc(), *keys).limit(HOT_KEYS))
    near = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(dim, keys)
    return near.unionByName(rest)


#: What a Python worker keeps from task to task, by the name of the operator that made it.
HELD: dict[str, object] = {}


def held(name: str, key: object, build: Callable[[], object]) -> object:
    """`build()`, kept for later tasks of the same worker as long as it works for operators that hold `name`."""
    if HELD.get(name, (None,))[0] != key:
        HELD[name] = (key, build())
    return HELD[name][1]


def let_go(but: str | None) -> None:
    """Drops what operators other than `but` have kept in this worker, and gives the memory back."""
    names = [n for n in HELD if n != but]
    for name in names:
        del HELD[name]
    if names:
        gc.collect()
        pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             fields: list[StructField], holds: str | None = None) -> DataFrame:
    """`fn` over the batches of each task; a worker that turns to it lets go of what operators other than `holds` have kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        yield from fn(batches)

    return df.mapInArrow(run, StructType(fields))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones, so that what a task builds for one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def read_file(path: str) -> bytes:
    """A file that the driver can read: a local path."""
    with open(os.fspath(path), "rb") as f:
        return f.read()


def extend(df: DataFrame, new: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], list]],
           keep: list[str] | None = None, rows: int = 256, holds: str | None = None) -> DataFrame:
    """`df` with new columns computed in Arrow batches of at most `rows` rows.

    `make` runs once per task and returns a function from a batch to the arrays
    (or lists) of the new columns. `keep` names the columns handed on, by default all.
    """
    names = carried(df, [f.name for f in new])
    names = [c for c in names if keep is None or c in keep]
    fields = [df.schema[c] for c in names] + new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in new]
        fn = make()
        for batch in slices(batches, rows):
            if not batch.num_rows:
                continue
            made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(fn(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + made, [f.name for f in fields])

    return map_rows(df, run, fields, holds)
