"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "a1_cell_stats", "a2_cell_vocab", "j5_point_in_polygon", "j6_covered", "j7_nearest", "j21_enrich",
    "w1_topk_candidates", "r1_refine_in_cell", "r2_select_by_content", "r7_joint_rerank", "a20_soft_targets",
    "w9_weighted_resample", "t4_merge_tiles", "d3_refine_decision", "a15_distance_summary", "q1_evaluate",
    "q2_oracle_floor", "q3_recall_at_k", "q4_oracle_selection", "x5_throttle",
)


def main() -> None:
    from cellselect.plans import load
    from cellselect.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
