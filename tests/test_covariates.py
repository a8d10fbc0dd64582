import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitalspan.plans.covariates import custom as C
from vitalspan.plans.covariates import domain as D
from vitalspan.plans.covariates import hdps as H
from vitalspan.plans.covariates import scores as S
from vitalspan.plans.covariates.settings import CovariateSettings, extract
from vitalspan.plans.covariates.tidy import tidy


class Tables:
    """Only the tables a test provides."""

    def __init__(self, spark, **frames):
        self.spark = spark
        self.__dict__.update(frames)


def to_date(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("date"))
    return df


@pytest.fixture
def people(frame):
    return frame([(1, 1960, 8507), (2, 1920, 8532)], "person_id long, year_of_birth long, gender_concept_id long")


@pytest.fixture
def cohort(frame):
    return to_date(frame(
        [(1, 11, 1, "2000-06-01"), (1, 12, 2, "2000-06-01")],
        "cohort_definition_id long, row_id long, subject_id long, cohort_start_date string"), "cohort_start_date")


@pytest.fixture
def labs(frame):
    return to_date(frame(
        [(1, 7, "2000-05-30", 10.0), (1, 7, "2000-05-30", 20.0), (1, 7, "2000-05-01", 99.0), (1, 7, "2000-06-02", 1.0)],
        "person_id long, measurement_concept_id long, measurement_date string, value_as_number double"), "measurement_date")


def test_recent_is_mean_of_nearest_day_and_missing_are_imputed(spark, frame, people, cohort, labs):
    t = Tables(spark, person=people, measurement=labs)
    spec = C.MeasurementCovariate((7,), start_day=-60, imputation=5.0, age_interaction=True)
    got = {r.row_id: r.covariate_value for r in C.measurement_covariate(t, cohort, spec).collect()}
    assert got == {11: 15.0 * 40, 12: 5.0 * 80}


@pytest.mark.parametrize("how,expected", [("max", 99.0), ("min", 10.0), ("mean", 43.0), ("median", 20.0), ("recent", 15.0)])
def test_reducers(spark, people, cohort, labs, how, expected):
    t = Tables(spark, person=people, measurement=labs)
    rows = C.measurement_rows(t, cohort, C.MeasurementCovariate((7,), start_day=-60))
    assert C.reduce_values(rows, how).first().covariate_value == pytest.approx(expected)


def test_age_alone_gives_a_score_row(spark, frame, people, cohort):
    empty = to_date(frame([(9, 9, "2000-01-01", "2000-01-01")], "person_id long, condition_concept_id long, condition_era_start_date string, condition_era_end_date string"), "condition_era_start_date", "condition_era_end_date")
    ca = frame([(1, 1, 0)], "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation long")
    t = Tables(spark, person=people, condition_era=empty, concept_ancestor=ca)
    assert {r.row_id: r.covariate_value for r in S.chads2(t, cohort).collect()} == {11: 0.0, 12: 1.0}


def test_frequency_thresholds(frame):
    freq = frame([(i, 5, f) for i, f in enumerate((1, 1, 2, 5))] + [(9, 6, 4)], "row_id long, code long, frequency long")
    freq = freq.withColumn("source", F.lit("ingredient"))
    got = {r.code: (r.median_value, r.q75_value) for r in H.thresholds(freq).collect()}
    assert got == {5: (1, 2), 6: (-9999, -9999)}


def test_aggregate_equals_row_counts(cdm):
    a = D.DomainAnalysis("condition_occurrence", 102)
    flags = D.domain_flags(cdm, cdm.cohort_rows, a)
    assert D.aggregate_flags(flags, cdm.cohort_rows).agg(F.sum("sum_value")).first()[0] == flags.count()


def test_windows_nest(cdm):
    def ids(start):
        rows = D.domain_flags(cdm, cdm.cohort_rows, D.DomainAnalysis("drug_exposure", 1, start)).collect()
        return {(r.row_id, r.covariate_id) for r in rows}

    short, long, ever = ids(-30), ids(-365), ids(None)
    assert short <= long <= ever and short


def test_tidy_state_is_reused(frame):
    cov = frame([(i, 1003, 1.0) for i in range(6)] + [(i, 2003, 1.0) for i in range(6, 10)] + [(0, 5102, 1.0)] + [(i, 1002, float(i)) for i in range(1, 10)],
                "row_id long, covariate_id long, covariate_value double")
    rows = frame([(i,) for i in range(10)], "row_id long")
    kept, state = tidy(cov, rows, min_fraction=0.2)
    assert {r.covariate_id for r in kept.select("covariate_id").distinct().collect()} == {2003, 1002}
    assert kept.agg(F.max("covariate_value")).first()[0] == 1.0
    new = frame([(50, 1002, 18.0), (50, 5102, 1.0)], "row_id long, covariate_id long, covariate_value double")
    assert [(r.covariate_id, r.covariate_value) for r in state.apply(new).collect()] == [(1002, 2.0)]


def test_extract_runs_custom_builders(cdm):
    def flag(_cdm, cohort):
        return cohort.select(*D.ROW, F.lit(77).cast("long").alias("covariate_id"), F.lit(1.0).alias("covariate_value"))

    out = extract(cdm, cdm.cohort_rows, CovariateSettings(demographics=("gender",), scores=("charlson",), custom=(flag,)))
    seen = {r[0] % 1000 for r in out.covariates.select("covariate_id").distinct().collect()}
    assert seen == {1, 901, 77}


def test_age_map_accepts_column_functions_and_pandas_udfs(spark, people, cohort):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def halved(age: pd.Series) -> pd.Series:
        return age / 2

    t = Tables(spark, person=people)
    for mapping in (halved, lambda age: age / 2):
        got = {r.row_id: r.covariate_value for r in C.age_map_covariate(t, cohort, mapping).collect()}
        assert got == {11: 20.0, 12: 40.0}


def test_outside_cohort_members_are_dropped(spark, frame, people, cohort, labs):
    other = to_date(frame([(5, 1, "2000-05-20", "2000-05-25")], "cohort_definition_id long, subject_id long, cohort_start_date string, cohort_end_date string"), "cohort_start_date", "cohort_end_date")
    t = Tables(spark, person=people, measurement=labs)
    spec = C.MeasurementCovariate((7,), start_day=-60, reduce="max")
    inside = C.measurement_cohort_covariate(t, cohort, other, 5, spec, "in").collect()
    assert [(r.row_id, r.covariate_value) for r in inside] == [(11, 99.0)]
    assert C.measurement_cohort_covariate(t, cohort, other, 5, spec, "out").count() == 0


def test_extraction_reads_a_domain_once_and_declares_everything(cdm):
    from vitalspan.plans.covariates.settings import CovariateSettings, aggregate, extract

    settings = CovariateSettings(
        demographics=("gender", "age"), domains={"condition_occurrence": ("any_time", "long", "short")}, groups={"condition_era": ("long",)},
        scores=("charlson",), measurement_values=True)
    data = extract(cdm, cdm.cohort_rows, settings)
    found = {r[0] for r in data.covariates.selectExpr("covariate_id % 1000").distinct().collect()}
    assert found == {1, 2, 101, 102, 104, 210, 705, 901}
    assert found == {r.analysis_id for r in data.analysis_ref.collect()}
    ids = {r.covariate_id for r in data.covariates.select("covariate_id").distinct().collect()}
    assert ids == {r.covariate_id for r in data.covariate_ref.collect()}
    rows = aggregate(data.covariates, data.analysis_ref, cdm.cohort_rows)
    assert {r[0] for r in rows.selectExpr("covariate_id % 1000").distinct().collect()} == found
    with __import__("pytest").raises(Exception, match="without reference"):
        aggregate(data.covariates, data.analysis_ref.where("analysis_id <> 2"), cdm.cohort_rows).collect()


def test_exclusion_lists_have_no_limit(cdm, spark):
    from vitalspan.operators.vocab import codeset
    from vitalspan.plans.covariates import domain as D

    many = list(range(5_000_000, 5_050_000))
    assert codeset(cdm.concept_ancestor, many).count() == 50_000
    a = D.exclude_with_descendants(cdm, D.DomainAnalysis("drug_exposure", 301), many)
    assert D.domain_flags(cdm, cdm.cohort_rows, a).count() == D.domain_flags(cdm, cdm.cohort_rows, D.DomainAnalysis("drug_exposure", 301)).count()


def test_groups_of_few_concepts_are_not_shuffled_by_concept(spark, frame, cohort):
    drugs = [(c, "Drug", "S", "Clinical Drug", "RxNorm", "x") for c in range(100, 3100)]
    concept = frame([*drugs, (1, "Drug", "S", "Ingredient", "RxNorm", "x"), (2, "Drug", "C", "ATC", "ATC", "A")],
                    "concept_id long, domain_id string, standard_concept string, concept_class_id string, vocabulary_id string, concept_code string")
    links = [(a, d) for d in range(100, 3100) for a in (1, 2)]
    ancestor = frame([*links, (1, 1), (2, 1)], "ancestor_concept_id long, descendant_concept_id long")
    eras = to_date(frame([(1, 1, "2000-05-01", "2000-05-09"), (1, 9, "2000-05-01", "2000-05-09"), (2, 1, "1990-05-01", "1990-05-09")],
                         "person_id long, drug_concept_id long, drug_era_start_date string, drug_era_end_date string"),
                   "drug_era_start_date", "drug_era_end_date")
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "4k")
        t = Tables(spark, concept=concept, concept_ancestor=ancestor, drug_era=eras)
        flags = D.domain_flags(t, cohort, D.DomainAnalysis("drug_era", 410, groups=True))
        plan = flags._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.row_id, r.covariate_id) for r in flags.collect()) == [(11, 1410), (11, 2410)]
    finally:
        spark.conf.set(key, was)
    assert "hashpartitioning(concept_id" not in plan


def test_latest_values_of_several_windows_share_one_join(spark, frame):
    rng = random.Random(8)
    days = ["2000-%02d-%02d" % (rng.randint(1, 12), rng.randint(1, 28)) for _ in range(9)] + ["1998-05-01", "2001-02-03"]
    records = [(rng.choice([1, 2, None]), rng.choice([7, 8, 0]), rng.choice([*days, None]), rng.choice([1, 2, None]), rng.choice([0.5, 1.5, -3.0, None]))
               for _ in range(150)]
    rows = [(1, 10, 1, "2000-06-30"), (2, 10, 1, "2000-06-30"), (1, 11, 2, "2001-02-03"), (1, 12, 3, "2000-06-30"), (1, 13, 1, "2000-09-01"),
            (1, 13, 2, "2000-03-01"), (1, 13, 2, "2000-03-01"), (1, 14, 1, None)]
    labs = to_date(frame(
        records, "person_id long, measurement_concept_id long, measurement_date string, unit_concept_id long, value_as_number double"), "measurement_date")
    cohort = to_date(frame(rows, "cohort_definition_id long, row_id long, subject_id long, cohort_start_date string"), "cohort_start_date")
    analyses = [D.DomainAnalysis("measurement", 705, -100), D.DomainAnalysis("measurement", 706, None, -5)]

    def expected(a):
        best = {}
        for cid, row, subject, start in rows:
            for person, concept, at, unit, value in records:
                if person != subject or not concept or None in (at, unit, value, start):
                    continue
                gap = (dt.date.fromisoformat(at) - dt.date.fromisoformat(start)).days
                if gap <= a.end_day and (a.start_day is None or gap >= a.start_day):
                    best.setdefault((cid, row, concept), []).append((at, -unit, -value, person))
        for (cid, row, concept), found in best.items():
            at, unit = max(found)[:2]
            value = max(min(-f[2] for f in found if f[:2] == (at, unit) and f[3] == p) for p in {f[3] for f in found if f[:2] == (at, unit)})
            yield cid, row, concept * 1000000 - unit * 1000 + a.analysis_id, value, a.analysis_id

    t = Tables(spark, measurement=labs)
    for some in (cohort, cohort.filter("row_id <> 13")):
        got = D.measurement_values_of(t, some, analyses)
        kept = {r.row_id for r in some.collect()}
        assert sorted(map(tuple, got.collect())) == sorted(x for a in analyses for x in expected(a) if x[1] in kept)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert "Aggregate [cohort_definition_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    one = D.measurement_values(t, cohort, analyses[0])
    assert sorted(map(tuple, one.collect())) == sorted(x[:4] for x in expected(analyses[0]))
