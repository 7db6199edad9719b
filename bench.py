"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lotlens.catalog import QUERIES, Tables  # noqa: E402
from lotlens.plans.session import local_session  # noqa: E402

HEADLINE = ["graded_bucket_table", "A01_look_aggregates", "A03_lot_shares", "A08_cluster_bootstrap", "A11_grade_lots", "R02_adjudicate_all_packs",
            "A15_pool_looks", "A21_compare_gradings", "A27_fleet_dashboard", "E06_rater_vs_rest", "E10_subgroup_metrics", "E19_recommend_threshold",
            "J13_candidate_matches", "J17_near_duplicates", "T01_audit_chain", "T06_merkle_root", "M08_activity_sessions"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus), "20g")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()  # start the JVM side
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]:
        start = time.perf_counter()
        QUERIES[name].run(Tables(spark, sf_dir, int(cpus))).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
