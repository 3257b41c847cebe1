"""Time the headline queries on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_supplier_ranking",
    "w1_midrank",
    "w1_midrank_prices",
    "j8_asof_interpolation",
    "j9_cross_scale_pairs",
    "m5_formula_inversion",
    "w4_tiling",
    "n9_panel_rows",
    "a4_overall_and_per_scale",
    "j7_histogram_lookup",
    "m12_candidate_scores",
    "m4_fixed_point",
    "m8_allocation_pieces",
    "m21_truncated_mean",
    "m22_marginal_level",
    "n7_fallback_scores",
    "j3_fuzzy_unambiguous",
    "d5_content_labels",
)


def main() -> None:
    from rankmill import catalog
    from rankmill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()
    # Start the executors and load the parquet reader before timing.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
