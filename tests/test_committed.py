"""Tables by batch that count every batch once, quantile sketches, sessions."""

import datetime as dt
import random

import pytest

from fleetlens.streaming import committed as C

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def run_of(spark, name, *packages):
    return spark.createDataFrame([(name, "p", "npm", *x) for x in packages], C.RUN)


def test_replayed_and_killed_batches(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "h")
    step = C.history_step(root)
    assert C.committed(spark, root, "runs", C.RUN).collect() == []
    first, second = run_of(spark, "r0", ("a", "1", False), ("b", "1", False)), run_of(spark, "r1", ("a", "2", False), ("b", "1", True), ("c", "1", False), ("d", None, None))
    step(first, 0)
    step(run_of(spark, "other", ("z", "9", True)), 0)  # committed: a replay writes nothing
    assert rows(C.committed(spark, root, "runs", C.RUN), "run", "package") == [("r0", "a"), ("r0", "b")]
    put = C._put

    def dies(df, root, name, batch_id):
        if name == "commits":
            raise RuntimeError("killed")
        put(df, root, name, batch_id)

    monkeypatch.setattr(C, "_put", dies)
    with pytest.raises(RuntimeError):
        step(second, 1)
    # Written but not committed: nobody sees it.
    assert rows(C.committed(spark, root, "new", C.RUN), "run", "package") == [("r0", "a"), ("r0", "b")]
    monkeypatch.setattr(C, "_put", put)
    step(second, 1)
    step(second, 1)
    assert rows(C.committed(spark, root, "new", C.RUN).where("run = 'r1'"), "package") == [("a",), ("b",), ("c",), ("d",)]
    step(run_of(spark, "r2", ("a", "2", False), ("d", None, None)), 2)
    assert rows(C.committed(spark, root, "new", C.RUN).where("run = 'r2'"), "package") == []
    assert C.committed(spark, root, "runs", C.RUN).count() == 8


def test_latency_within_its_rank_error(spark, tmp_path):
    root, rng, n, k = str(tmp_path / "l"), random.Random(5), 30_000, 400
    values = [round(rng.lognormvariate(3, 1), 4) for _ in range(n)]
    step = C.latency_step(root, "1 day", 600, "1 hour", k)
    for i in range(3):
        part = values[i::3]
        step(spark.createDataFrame([("hot", at(i * 10), v, v > 50) for v in part] + [("few", at(i), float(i), None), (None, at(i), None, None)], C.REQUEST), i)
    got = {r.host: r for r in C.latency(spark, root).collect()}
    assert (got["hot"].requests, got["hot"].errors) == (n, sum(v > 50 for v in values))
    below = sum(v < got["hot"].p95 for v in values) / n
    assert abs(below - 0.95) <= 2 * 2.3 / k
    assert (got["few"].requests, got["few"].errors, got["few"].p95) == (3, 0, 2.0)
    assert (got[None].requests, got[None].p95) == (3, None)


def test_sessions_and_late_rows(spark, tmp_path):
    root = str(tmp_path / "s")
    step = C.latency_step(root, "1 hour", 100, "200 seconds", 200)
    request = lambda host, *seconds: [(host, at(s), 1.0, False) for s in seconds]
    # A row of the last batch joins two stretches of the one before; what comes 100 seconds after is a new session.
    batches = [request("a", 0, 99, 250) + request("b", 0), request("b", 190, 299) + request("a", 350),
               request("b", 250, 95) + request("a", 449, 100) + [("c", None, 1.0, False)]]
    for i, batch in enumerate(batches):
        step(spark.createDataFrame(batch, C.REQUEST), i)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = sorted((r.host, (r.start - base) // 1_000_000, (r.end - base) // 1_000_000, r.requests) for r in C.sessions(spark, root, 100).collect())
    assert got == [("a", 0, 99, 2), ("a", 250, 250, 1), ("a", 350, 449, 2), ("b", 0, 0, 1), ("b", 190, 299, 3)]
    late = [(r.host, r.event_time and int((r.event_time - T0).total_seconds())) for r in C.committed(spark, root, "late", C.REQUEST).collect()]
    assert sorted(late) == [("a", 100), ("b", 95), ("c", None)]
    assert C.latency(spark, root).agg({"requests": "sum"}).first()[0] == 9
