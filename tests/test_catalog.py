"""Every registered plan against its reference SQL.

The plans are started side by side; each test waits for its own. VITALSPAN_SOME=1
runs a cross-section only.
"""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from conftest import DATA

from vitalspan.catalog import load
from vitalspan.sources.derived import RAW_TABLES

SOME = """drug_era sub_exposures interval_algebra collapse_cohort scan_cdm cohort_upsert result_store delete_rows
end_date_resolve range_group age_exact_days nearby_event_join window_join case_total_report cohort_family cohort_stats
generate_cohort_set cohort_incremental af_stroke_cohorts t2dm_hospitalisation negative_control cov_domain_concept
cov_concept_count_agg cov_measurement_value cov_measurement_value_agg cov_charlson cov_chads2vasc cov_dcsi cov_hfrs cov_hdps
hdps_thresholds cov_temporal tidy_covariates std_diff cov_cohort cov_measurement cov_measurement_cohort global_row_id
fill_missing identify_runs running_max quantile_position attrition population_variants split_stratified split_subject
undersample auc auprc threshold_summary calibration_summary covariate_summary survival_curve recalibrate_weak pfi fit_knn
pivot_margins json_array_rows vec_chop dedup_by_digest scalar_date text_profile""".split()

QUERIES = load()
NAMES = [n for n, q in QUERIES.items() if q.sql and (n in SOME or not os.environ.get("VITALSPAN_SOME"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark, request):
    """Columns and rows of the selected plans, as they become ready."""
    wanted = [i.callspec.params["name"] for i in request.session.items if getattr(i, "callspec", None) and "name" in i.callspec.params]

    def run(name):
        df = QUERIES[name].run(spark, DATA)
        return df.columns, df.collect()

    with ThreadPoolExecutor(5) as pool:
        yield {n: pool.submit(run, n) for n in dict.fromkeys(wanted)}


def canonical(rows, kinds):
    def cell(v, k):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if k == "f":
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(cell(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_reference(results, duck, name):
    q = QUERIES[name]
    kinds = [k for _, k in q.columns]
    columns, rows = results[name].result()
    assert columns == [c for c, _ in q.columns]
    ours, theirs = canonical(rows, kinds), canonical(duck.execute(q.sql).fetchall(), kinds)
    assert len(ours) == len(theirs) > 0
    assert ours == theirs


def test_every_query_has_columns_and_most_have_sql():
    assert len(QUERIES) > 270
    assert sum(q.sql is not None for q in QUERIES.values()) > 250


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
