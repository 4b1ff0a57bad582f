"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS choose data and cores; BENCH_QUERIES (comma list or
"all") and BENCH_REPEAT narrow or widen the run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.queries import QUERIES  # noqa: E402
from fleetlens.session import build_session, release  # noqa: E402

HEADLINE = (
    "statement_digest", "index_candidates", "snapshot_diff", "dir_rollup", "duplicate_members", "word_count", "freshness_findings",
    "seo_findings", "redirect_match", "redirect_chains", "redirect_loops", "metadata_compare", "catalog_qa", "secret_scan", "env_drift",
    "advisory_join", "policy_findings", "media_reconcile", "uptime_pct", "incidents", "alert_suppress", "peak_concurrency",
    "interval_lookup", "charset_drift", "response_checks", "image_inventory", "reachability", "jsonld_flatten", "tile_invalid_gids",
    "stream_alerts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    folder = os.environ.get("BENCH_STAGING") or tempfile.mkdtemp(prefix="fleetlens-bench-")
    spark = build_session("fleetlens-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "repeat": repeat,
        "settings": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
