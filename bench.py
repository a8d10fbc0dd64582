"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose the
tables and the local cores. Each query runs to a no-op sink, so every output
row is computed; the best of three runs counts after a first warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from vitalspan.catalog import load
from vitalspan.session import local_session

HEADLINE = (
    "drug_era", "case_total_report", "cohort_family", "generate_cohort_set", "cohort_stats", "cov_domain_concept",
    "cov_condition_group", "cov_measurement_value", "cov_measurement_value_agg", "cov_concept_count_agg", "cov_charlson",
    "cov_hdps", "tidy_covariates", "continuous_summary", "nonmissing_summary", "study_population", "split_stratified",
    "auc", "calibration_summary", "interval_algebra", "event_ordinal", "fill_missing", "global_row_id", "pivot_margins",
    "dedup_by_digest",
)


def run(plan, spark, folder) -> float:
    start = time.perf_counter()
    plan(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "16g"), "bench")
    catalog = load()
    run(catalog["cov_gender"].run, spark, folder)
    run(catalog["codeset"].run, spark, folder)
    times = {}
    for name in HEADLINE:
        times[name] = round(min(run(catalog[name].run, spark, folder) for _ in range(3)), 3)
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
