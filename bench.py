"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = [
    "N06_three_region", "N18_post_bleach", "N20_align", "A02_mean_curve", "A11_shape_features", "F01_fit_single_round", "F01_fit_single", "F02_fit_double",
    "F12_fit_all_models", "F22_global_fit", "F27_per_cell_fits", "F31_recording_metrics", "X03_mann_whitney", "X05_kruskal", "X17_permutation",
    "X18_bootstrap_interval", "X23_mixed_model", "G03_drift_shifts", "G09_otsu_area", "J09_nearest_neighbors", "O09_isolation_forest", "P15_downsample",
]


def main() -> None:
    from rekurve.plans import catalog
    from rekurve.plans.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or QUERIES
    spark = local_session(cpus, cpus)
    # start the JVM's code paths and the Python workers once
    catalog.QUERIES["N12_bleach_minimum"](spark, sf).write.format("noop").mode("overwrite").save()
    spark.range(100).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times, counts = {}, {}
    for name in chosen:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    curves = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    points = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    rates = {}
    if "F02_fit_double" in times:
        rates["double_fits_per_s"] = round(curves / times["F02_fit_double"], 1)
    if "F12_fit_all_models" in times:
        rates["model_fits_per_s"] = round(6 * curves / times["F12_fit_all_models"], 1)
    if "N06_three_region" in times:
        rates["normalized_points_per_s"] = round(points / times["N06_three_region"], 1)
    if "X17_permutation" in times:
        rates["permutation_replicates_per_s"] = round(1000 / times["X17_permutation"], 2)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "rates": rates}))


if __name__ == "__main__":
    main()
