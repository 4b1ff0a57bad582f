"""Run queries next to their SQL twins and compare the rows as multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.12g}")
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        return False, f"{len(got)} vs {len(want)} rows; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    return True, f"{len(got)} rows {took:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from fleetlens.session import build_session

    sf = "/root/testdata/sf0.01"
    only = sys.argv[1:]
    session = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for key, call in entry.queries().items():
        if only and not any(o in key for o in only):
            continue
        try:
            if key in oracle:
                ok, note = compare(session, connection, call, oracle[key], sf)
            else:
                t0 = time.time()
                ok, note = True, f"{call(session, sf).count()} rows (no oracle) {time.time() - t0:.1f}s"
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", key, note, flush=True)
    print("failures:", bad)
