"""Target rows, outcomes and the study population."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import age_by_year, days_between
from vitalspan.operators.ranges import interval_counts, period_of
from vitalspan.operators.ranks import row_numbers
from vitalspan.operators.sampling import stable_sample
from vitalspan.plans.study_cohorts import first_exposure_minmin


@dataclass(frozen=True)
class TargetSpec:
    """``row_id`` names an existing unique column, else ids are numbered in
    (subject, start) order."""

    first_only: bool = False
    washout_days: int = 0
    study_start: str | None = None
    study_end: str | None = None
    sample_size: int | None = None
    row_id: str | None = None


def plp_cohort(cdm, cohort: DataFrame, spec: TargetSpec = TargetSpec()) -> DataFrame:
    """Target rows with their position in the observation period."""
    rows = first_exposure_minmin(cohort) if spec.first_only else cohort
    rows = period_of(rows, cdm.observation_period, "cohort_start_date", "subject_id")
    person = cdm.person.select(
        F.col("person_id").alias("subject_id"), "year_of_birth", F.col("gender_concept_id").alias("gender"))
    rows = rows.join(person, "subject_id")
    start, end = F.col("cohort_start_date"), F.col("cohort_end_date")
    if spec.study_start:
        rows = rows.filter(start >= F.lit(spec.study_start).cast("date"))
    stop = F.lit(spec.study_end).cast("date") if spec.study_end else None
    if stop is not None:
        rows = rows.filter(start < stop)
    rows = rows.filter(days_between("op_start_date", "cohort_start_date") >= spec.washout_days)
    if spec.sample_size:
        rows = stable_sample(rows, "subject_id", "cohort_start_date", spec.sample_size)
    clip = (lambda c: F.least(c, stop)) if stop is not None else (lambda c: c)
    base = rows.select(
        *([F.col(spec.row_id).alias("row_id")] if spec.row_id else []),
        "subject_id", "cohort_definition_id", "cohort_start_date", "cohort_end_date",
        days_between("op_start_date", "cohort_start_date").alias("days_from_obs_start"),
        F.datediff(clip(end), start).alias("days_to_cohort_end"),
        F.datediff(clip(F.col("op_end_date")), start).alias("days_to_obs_end"),
        age_by_year("cohort_start_date", "year_of_birth").alias("age_year"), "gender")
    return base if spec.row_id else row_numbers(base, [], ["subject_id", "cohort_start_date"], "row_id")


def _observed(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (row, outcome, days) for events inside the observed time.

    Events are distinct per subject, outcome and day before the join; every
    surviving pair is an output row.
    """
    at = days_between("cohort_start_date", "event_date")
    return rows.select("row_id", "subject_id", "cohort_start_date", "days_from_obs_start", "days_to_obs_end").join(
        events, "subject_id"
    ).withColumn("days_to_event", at).filter(
        (-F.col("days_to_event") <= F.col("days_from_obs_start")) & (F.col("days_to_event") <= F.col("days_to_obs_end"))
    ).select("row_id", "outcome_id", "days_to_event").distinct()


def outcome_days(cohort: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Distinct (subject, outcome, day) from a cohort table."""
    return cohort.filter(F.col("cohort_definition_id").isin(list(ids))).select(
        "subject_id", F.col("cohort_definition_id").alias("outcome_id"), F.col("cohort_start_date").alias("event_date")
    ).distinct()


def plp_outcomes(rows: DataFrame, cohort: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Outcomes of each target row from a cohort table."""
    return _observed(rows, outcome_days(cohort, ids))


def era_outcomes(cdm, rows: DataFrame, ancestors: Sequence[int]) -> DataFrame:
    """Outcomes from condition eras of the ancestors' descendants."""
    below = cdm.concept_ancestor.filter(F.col("ancestor_concept_id").isin(list(ancestors))).select(
        F.col("ancestor_concept_id").alias("outcome_id"), F.col("descendant_concept_id").alias("condition_concept_id"))
    events = cdm.condition_era.join(below, "condition_concept_id").select(
        F.col("person_id").alias("subject_id"), "outcome_id", F.col("condition_era_start_date").alias("event_date")
    ).distinct()
    return _observed(rows, events)


@dataclass(frozen=True)
class PopulationSpec:
    washout_days: int = 0
    first_exposure_only: bool = False
    remove_prior_outcome: bool = True
    prior_lookback: int = 99999
    risk_start: int = 1
    risk_end: int = 365
    start_anchor: str = "cohort start"
    end_anchor: str = "cohort start"
    require_time_at_risk: bool = True
    min_time_at_risk: int = 364
    include_all_outcomes: bool = True
    binary: bool = True


STEPS = ("original", "first_exposure", "washout", "prior_outcome", "negative_time", "time_at_risk")


def _in_window(timed: DataFrame, days: DataFrame, lo, hi, n: str, first: str) -> DataFrame:
    """Add the number of outcome days in [lo, hi] (day offsets) and the first
    of them as an offset."""
    start = F.col("cohort_start_date")
    framed = timed.withColumn("_lo", F.date_add(start, lo)).withColumn("_hi", F.date_add(start, hi))
    found = interval_counts(framed, days, ["subject_id"], "_lo", "_hi", "event_date")
    return framed.join(found, ["subject_id", "_lo", "_hi"], "left").select(
        *timed.columns, F.coalesce("n", F.lit(0)).alias(n), F.datediff("first", start).alias(first))


def population_flags(rows: DataFrame, events: DataFrame, outcome_id: int, spec: PopulationSpec) -> DataFrame:
    """Target rows with the time at risk, outcome summary and one boolean per
    step: the row passes this step and every step before it.

    ``events`` are outcome days per subject (see ``outcome_days``); target
    rows and outcome days of a subject are swept, never paired.
    """
    def anchor(kind, offset):
        return (F.col("days_to_cohort_end") if kind == "cohort end" else F.lit(0)) + offset

    timed = rows.withColumn("tar_start", anchor(spec.start_anchor, spec.risk_start)).withColumn(
        "tar_end", F.least(anchor(spec.end_anchor, spec.risk_end), F.col("days_to_obs_end")))
    days = events.filter(F.col("outcome_id") == outcome_id).select("subject_id", "event_date").distinct()
    joined = _in_window(
        timed, days, F.greatest("tar_start", -F.col("days_from_obs_start")).cast("int"), F.col("tar_end").cast("int"), "_inside", "_first")
    if spec.remove_prior_outcome:
        since = F.greatest(F.col("tar_start") - spec.prior_lookback, -F.col("days_from_obs_start"))
        until = F.least(F.col("tar_start") - 1, F.col("days_to_obs_end"))
        joined = _in_window(joined, days, since.cast("int"), until.cast("int"), "_before", "_earliest")
    if spec.first_exposure_only:
        first = rows.groupBy("subject_id").agg(F.min("cohort_start_date").alias("_first_start"))
        joined = joined.join(first, "subject_id")
        is_first = F.col("cohort_start_date") == F.col("_first_start")
    else:
        is_first = F.lit(True)
    n_inside = F.col("_inside")
    length = F.col("tar_end") - F.col("tar_start")
    enough = length >= spec.min_time_at_risk
    if spec.include_all_outcomes:
        enough = enough | (n_inside > 0)
    tests = [
        F.lit(True), is_first, F.col("days_from_obs_start") >= spec.washout_days,
        (F.col("_before") == 0) if spec.remove_prior_outcome else F.lit(True),
        length >= 0, enough if spec.require_time_at_risk else F.lit(True),
    ]
    passed, flags = F.lit(True), []
    for name, test in zip(STEPS, tests, strict=True):
        passed = passed & test
        flags.append(passed.alias(f"step_{name}"))
    count = F.least(n_inside, F.lit(1)) if spec.binary else n_inside
    return joined.select(
        *rows.columns, "tar_start", "tar_end", count.cast("long").alias("outcome_count"),
        (F.coalesce(F.col("_first"), F.col("tar_end")) - F.col("tar_start") + 1).alias("survival_time"), *flags)


def study_population(rows, events, outcome_id: int, spec: PopulationSpec) -> DataFrame:
    flagged = population_flags(rows, events, outcome_id, spec)
    return flagged.filter(F.col(f"step_{STEPS[-1]}")).drop(*[f"step_{s}" for s in STEPS])


def attrition(rows, events, outcome_id: int, spec: PopulationSpec) -> DataFrame:
    """Rows, people and rows with the outcome left after each step, in one pass."""
    flagged = population_flags(rows, events, outcome_id, spec)
    steps = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(s).alias("description"), F.col(f"step_{s}").alias("kept"))
        for i, s in enumerate(STEPS)])
    long = flagged.select("subject_id", "outcome_count", F.explode(steps).alias("s")).filter("s.kept")
    return long.groupBy(F.col("s.step").alias("step"), F.col("s.description").alias("description")).agg(
        F.count(F.lit(1)).alias("target_count"), F.countDistinct("subject_id").alias("unique_people"),
        F.sum((F.col("outcome_count") > 0).cast("int")).alias("outcomes"))


def population_variants(spec: PopulationSpec) -> dict[str, PopulationSpec]:
    """The combinations of prior-outcome, time-at-risk and all-outcome switches."""
    out = {}
    for prior in (False, True):
        for require, everyone in ((False, False), (True, False), (True, True)):
            name = f"prior={int(prior)} require={int(require)} all={int(everyone)}"
            out[name] = replace(
                spec, remove_prior_outcome=prior, require_time_at_risk=require, include_all_outcomes=everyone)
    return out
