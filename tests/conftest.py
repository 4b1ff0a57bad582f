from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fleetlens.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("fleetlens-tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stage"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column over one row of named string values."""
    def run(make, **values):
        from pyspark.sql import functions as F
        names = list(values)
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
        return df.select(make(*[F.col(n) for n in names]).alias("x")).first()["x"]
    return run
