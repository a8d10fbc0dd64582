"""Stand-alone study cohorts built directly from the record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import days_between
from vitalspan.functions.predicates import filter_concepts
from vitalspan.operators.ranges import first_dates, overlap_join, period_of, without_earlier
from vitalspan.operators.vocab import expand_descendants
from vitalspan.plans import params as P
from vitalspan.session import literal_frame

COHORT = ["cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"]


def _cohort(df: DataFrame, cid: int, subject: str, start, end) -> DataFrame:
    return df.select(
        F.lit(cid).cast("long").alias("cohort_definition_id"), F.col(subject).alias("subject_id"),
        start.alias("cohort_start_date"), end.alias("cohort_end_date"))


def first_exposure_minmin(rows: DataFrame) -> DataFrame:
    """Earliest start and earliest end per subject and cohort, independently."""
    return rows.groupBy("cohort_definition_id", "subject_id").agg(
        F.min("cohort_start_date").alias("cohort_start_date"), F.min("cohort_end_date").alias("cohort_end_date"))


def new_user_cohorts(cdm, drugs: Sequence[int], washout_days: int = 365) -> DataFrame:
    """First use of each drug with enough history, era inside the period."""
    eras = filter_concepts(cdm.drug_era, "drug_concept_id", drugs).select(
        F.col("drug_concept_id").alias("cohort_definition_id"), F.col("person_id").alias("subject_id"),
        F.col("drug_era_start_date").alias("cohort_start_date"), F.col("drug_era_end_date").alias("cohort_end_date"))
    rows = period_of(first_exposure_minmin(eras), cdm.observation_period, "cohort_start_date", "subject_id")
    return rows.filter(
        (F.col("cohort_end_date") <= F.col("op_end_date"))
        & (days_between("op_start_date", "cohort_start_date") >= washout_days)).select(*COHORT)


def _concept_dates(cdm, table: str, ids: DataFrame, concept: str, date: str) -> DataFrame:
    return getattr(cdm, table).join(ids.withColumnRenamed("concept_id", concept), concept, "left_semi").select(
        "person_id", F.col(date).alias("event_date"))


def t2dm_hospitalisation(cdm, pre_days: int, post_days: int) -> DataFrame:
    """1: first hospital visit of people with earlier type 2 diabetes and
    observation on both sides; 2: visits within ``post_days`` after it."""
    diabetes = _concept_dates(
        cdm, "condition_occurrence", expand_descendants(cdm.concept_ancestor, [P.TYPE_2_DIABETES]),
        "condition_concept_id", "condition_start_date")
    onset = first_dates(diabetes, ["person_id"], "event_date", "onset")
    visits = cdm.visit_occurrence.filter(F.col("visit_concept_id").isin(9201, 9203)).select(
        "person_id", "visit_start_date", "visit_end_date")
    period = cdm.observation_period
    eligible = visits.join(onset, "person_id").filter(
        days_between("onset", "visit_start_date") > pre_days
    ).join(period, "person_id").filter(
        (days_between("observation_period_start_date", "visit_start_date") > pre_days)
        & (F.col("visit_start_date") > F.col("observation_period_start_date"))
        & (days_between("visit_start_date", "observation_period_end_date") > post_days)
        & (F.col("visit_start_date") < F.col("observation_period_end_date")))
    first = eligible.groupBy("person_id").agg(F.min("visit_start_date").alias("first_visit"))
    index = _cohort(first, 1, "person_id", F.col("first_visit"), F.date_add("first_visit", post_days))
    return index.unionByName(readmissions(index, visits, 2))


def readmissions(index: DataFrame, visits: DataFrame, cid: int) -> DataFrame:
    """Visits after the index date and up to the cohort end; one index row
    per subject."""
    rows = index.select(F.col("subject_id").alias("person_id"), "cohort_start_date", "cohort_end_date")
    later = visits.join(rows, "person_id").filter(
        (F.col("visit_start_date") > F.col("cohort_start_date")) & (F.col("visit_start_date") <= F.col("cohort_end_date")))
    return _cohort(later, cid, "person_id", F.col("visit_start_date"), F.col("visit_end_date"))


def visits_with_condition(cdm, concepts: DataFrame, visit_kinds: Sequence[int], cid: int) -> DataFrame:
    """Visits during which a listed condition starts, each once."""
    days = _concept_dates(cdm, "condition_occurrence", concepts, "condition_concept_id", "condition_start_date").distinct()
    days = days.withColumn("_day", F.col("event_date"))
    visits = cdm.visit_occurrence.filter(F.col("visit_concept_id").isin(list(visit_kinds))).select(
        "person_id", "visit_start_date", "visit_end_date").distinct()
    hit = overlap_join(
        days, visits, ["person_id"], "event_date", "_day", "visit_start_date", "visit_end_date", width=31)
    stays = hit.select("person_id", "visit_start_date", "visit_end_date").distinct()
    return _cohort(stays, cid, "person_id", F.col("visit_start_date"), F.col("visit_end_date"))


def _first_condition(cdm, concepts: Sequence[int]) -> DataFrame:
    dates = _concept_dates(
        cdm, "condition_occurrence", expand_descendants(cdm.concept_ancestor, concepts), "condition_concept_id",
        "condition_start_date")
    return first_dates(dates, ["person_id"], "event_date", "index_date")


def af_stroke_cohorts(cdm, prior_days: int = 1095) -> DataFrame:
    """1: first atrial fibrillation without earlier warfarin; 2: inpatient strokes."""
    atrial = period_of(
        _first_condition(cdm, [P.ATRIAL_FIBRILLATION]), cdm.observation_period, "index_date")
    atrial = atrial.filter(F.col("index_date") >= F.date_add("op_start_date", prior_days))
    warfarin = _concept_dates(
        cdm, "drug_exposure", expand_descendants(cdm.concept_ancestor, [P.DRUGS["warfarin"]]), "drug_concept_id",
        "drug_exposure_start_date")
    target = without_earlier(atrial, warfarin, ["person_id"], "event_date", F.col("index_date"))
    # The published condition is a union: descendants of the listed ancestors
    # plus the listed single concepts wherever they occur as descendants.
    strokes = cdm.concept_ancestor.filter(
        F.col("ancestor_concept_id").isin(list(P.STROKE_ANCESTORS))
        | F.col("descendant_concept_id").isin(list(P.STROKE_EXTRA))
    ).select(F.col("descendant_concept_id").alias("concept_id")).distinct()
    return _cohort(target, 1, "person_id", F.col("index_date"), F.col("op_end_date")).unionByName(
        visits_with_condition(cdm, strokes, (9201, 262), 2))


def ace_angioedema_cohorts(cdm, prior_days: int = 364) -> DataFrame:
    """1: first ACE inhibitor with enough history; 2: angioedema conditions."""
    ace = _concept_dates(
        cdm, "drug_exposure", expand_descendants(cdm.concept_ancestor, P.ACE_INHIBITORS), "drug_concept_id",
        "drug_exposure_start_date")
    first = period_of(
        first_dates(ace, ["person_id"], "event_date", "index_date"), cdm.observation_period, "index_date")
    first = first.filter(F.col("index_date") >= F.date_add("op_start_date", prior_days))
    swelling = _concept_dates(
        cdm, "condition_occurrence", expand_descendants(cdm.concept_ancestor, [P.ANGIOEDEMA]), "condition_concept_id",
        "condition_start_date")
    return _cohort(first, 1, "person_id", F.col("index_date"), F.col("op_end_date")).unionByName(
        _cohort(swelling, 2, "person_id", F.col("event_date"), F.col("event_date")))


def negative_controls(
    cdm, outcomes: Sequence[tuple[int, int]], include_descendants: bool = True, occurrence: str = "first",
) -> DataFrame:
    """Outcome cohorts from (cohort id, concept id) pairs."""
    wanted = literal_frame(cdm.spark, list(outcomes), "cohort_definition_id long, outcome_concept_id long")
    if include_descendants:
        codes = wanted.join(cdm.concept_ancestor, F.col("outcome_concept_id") == F.col("ancestor_concept_id")).select(
            "cohort_definition_id", F.col("descendant_concept_id").alias("condition_concept_id")).distinct()
    else:
        codes = wanted.select("cohort_definition_id", F.col("outcome_concept_id").alias("condition_concept_id"))
    rows = cdm.condition_occurrence.join(codes, "condition_concept_id").select(
        "cohort_definition_id", F.col("person_id").alias("subject_id"),
        F.col("condition_start_date").alias("cohort_start_date"))
    if occurrence == "first":
        rows = rows.groupBy("cohort_definition_id", "subject_id").agg(
            F.min("cohort_start_date").alias("cohort_start_date"))
    return rows.withColumn("cohort_end_date", F.col("cohort_start_date")).select(*COHORT)
