"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Results go to the noop sink, so every
row and column is computed. Rows per second are reported for the row-wise pipelines.
"""

from __future__ import annotations

import json
import os
import sys
import time

from riskspark.plans.registry import QUERIES
from riskspark.session import build_session

HEADLINE = [
    "features_32_batch", "fuse_full_batch", "w_velocity_counts", "w_device_users_24h", "w_new_location",
    "state_velocity_asof", "ato_score", "mandate_execute", "hold_resolve", "split_temporal", "m_pr_auc",
    "psi_feature", "latency_summary", "sink_upsert_decisions", "canon_card", "st_features",
]
PER_ROW = ["features_32_batch", "fuse_full_batch", "st_features"]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = build_session(f"local[{cpus}]", partitions=int(cpus))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0").count()
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    rates = {n: round(rows / seconds[n], 1) for n in PER_ROW if n in seconds}
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rows": rows, "rows_per_sec": rates}))


if __name__ == "__main__":
    main()
