"""Drug-safety signal counts: exposed cases per drug against all drugs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import age_by_days, age_by_year, days_inclusive
from vitalspan.functions.predicates import code_prefix_any, compare, filter_concepts, name_contains_any
from vitalspan.operators.intervals import collapse_intervals
from vitalspan.operators.ranges import overlap_join, window_counts, without_earlier
from vitalspan.plans import params as P
from vitalspan.session import materialize


@dataclass(frozen=True)
class SignalSpec:
    drug_names: tuple[str, ...]
    prior_codes: tuple[str, ...]
    outcome_codes: tuple[str, ...]
    max_age: int | None = None
    min_age: int | None = None
    min_days: int = 7
    inclusive_days: bool = True
    prior_gap: int = 60
    outcome_days: int = 60
    outcome_anchor: str = "end"  # end | start of the era
    age_rule: str = "days"  # days | year
    # A normal baseline lab in [-60, 0] is not required by default, which
    # reproduces the published counts.
    baseline_concepts: tuple[int, ...] = ()
    baseline_limit: float | None = None
    # Criteria by standard concept instead of source code prefixes.
    prior_concepts: tuple[int, ...] = ()
    outcome_concepts: tuple[int, ...] = ()


LIVER = SignalSpec(P.LIVER_SIGNAL_DRUGS, P.LIVER_SIGNAL_PRIOR, P.LIVER_SIGNAL_OUTCOME, max_age=65)
KIDNEY = SignalSpec(P.KIDNEY_SIGNAL_DRUGS, P.KIDNEY_SIGNAL_PRIOR, P.KIDNEY_SIGNAL_OUTCOME, min_age=18)


def era_names(cdm) -> DataFrame:
    """Lower-case names of the drugs that have eras, written.

    Few drugs of a vocabulary have eras. The names of all would take more room
    in every task the larger the vocabulary is, and once too many to be sent to
    all tasks they would shuffle the eras by drug, a task for each.
    """
    own = cdm.drug_era.select("drug_concept_id").distinct()
    names = cdm.concept.select(
        F.col("concept_id").alias("drug_concept_id"), F.lower("concept_name").alias("ingredient_name"))
    return materialize(names.join(own, "drug_concept_id", "left_semi"), "era-names")


def eligible_eras(cdm, spec: SignalSpec) -> DataFrame:
    """Eras of all drugs with names, long enough and in the age range. Eras are
    read twice."""
    person = cdm.person.select("person_id", "year_of_birth", "month_of_birth", "day_of_birth")
    names = era_names(cdm)
    if spec.age_rule == "days":
        age = age_by_days("drug_era_start_date", "year_of_birth", "month_of_birth", "day_of_birth")
    else:
        age = age_by_year("drug_era_start_date", "year_of_birth")
    eras = cdm.drug_era.withColumn(
        "exposure_days", days_inclusive("drug_era_start_date", "drug_era_end_date", spec.inclusive_days)
    ).filter(F.col("exposure_days") >= spec.min_days)
    rows = eras.join(person, "person_id").join(names, "drug_concept_id").withColumn("age_onset", age)
    if spec.max_age is not None:
        rows = rows.filter(F.col("age_onset") <= spec.max_age)
    if spec.min_age is not None:
        rows = rows.filter(F.col("age_onset") >= spec.min_age)
    return rows.select(
        "person_id", "age_onset", "drug_concept_id", "ingredient_name", "drug_era_start_date", "drug_era_end_date",
        "exposure_days")


def exposed_eras(cdm, spec: SignalSpec) -> DataFrame:
    return _named(eligible_eras(cdm, spec), spec)


def conditions_of(cdm, codes: tuple[str, ...], concepts: tuple[int, ...]) -> DataFrame:
    """Condition records by concept ids where they are given, else by prefixes
    of the source code."""
    rows = cdm.condition_occurrence
    if concepts:
        return filter_concepts(rows, "condition_concept_id", concepts)
    return rows.filter(code_prefix_any("condition_source_value", codes))


def without_prior_disease(cdm, eras: DataFrame, spec: SignalSpec) -> DataFrame:
    prior = conditions_of(cdm, spec.prior_codes, spec.prior_concepts)
    return without_earlier(
        eras, prior, ["person_id"], "condition_start_date", F.date_sub("drug_era_start_date", spec.prior_gap))


def with_normal_baseline(cdm, eras: DataFrame, spec: SignalSpec) -> DataFrame:
    if not spec.baseline_concepts:
        return eras
    limit = F.col("range_high") if spec.baseline_limit is None else F.lit(spec.baseline_limit)
    labs = cdm.measurement.filter(F.col("measurement_concept_id").isin(list(spec.baseline_concepts)))
    normal = F.coalesce(compare(F.col("value_as_number"), "<=", limit), F.lit(False))
    counted = window_counts(
        eras, labs, ["person_id"], "drug_era_start_date", "measurement_date", -60, 0, {"normal_labs": normal})
    return counted.filter(F.col("normal_labs") > 0).drop("normal_labs")


def kept_eras(cdm, eras: DataFrame, spec: SignalSpec) -> DataFrame:
    """Eras without prior disease and, where asked for, with a normal baseline."""
    return with_normal_baseline(cdm, without_prior_disease(cdm, eras, spec), spec)


def cases(cdm, kept: DataFrame, spec: SignalSpec, by: list[str]) -> DataFrame:
    """Distinct (person, by, outcome code) with an outcome in the risk window
    of a kept era.

    Risk windows of one person and group merge first, so the join sees
    disjoint windows and one row per person, code and day.
    """
    anchor = "drug_era_end_date" if spec.outcome_anchor == "end" else "drug_era_start_date"
    windows = collapse_intervals(
        kept.select(
            "person_id", *by, F.col("drug_era_start_date").alias("risk_start"),
            F.date_add(anchor, spec.outcome_days).alias("risk_end")),
        ["person_id", *by], "risk_start", "risk_end")
    outcomes = conditions_of(cdm, spec.outcome_codes, spec.outcome_concepts).select(
        "person_id", "condition_source_value", "condition_start_date").distinct()
    outcomes = outcomes.withColumn("_day", F.col("condition_start_date"))
    hit = overlap_join(
        outcomes, windows, ["person_id"], "condition_start_date", "_day", "risk_start", "risk_end", width=92)
    return hit.select("person_id", *by, "condition_source_value").distinct()


def _named(eras: DataFrame, spec: SignalSpec) -> DataFrame:
    return eras.filter(name_contains_any("ingredient_name", spec.drug_names))


def _by_drug(cdm, kept: DataFrame, spec: SignalSpec) -> DataFrame:
    found = cases(cdm, kept, spec, ["ingredient_name"])
    return found.groupBy("condition_source_value", "ingredient_name").agg(F.count(F.lit(1)).alias("case_count"))


def _total(cdm, kept: DataFrame, spec: SignalSpec) -> DataFrame:
    return cases(cdm, kept, spec, []).groupBy("condition_source_value").agg(F.count(F.lit(1)).alias("total_count"))


def case_counts(cdm, spec: SignalSpec) -> DataFrame:
    return _by_drug(cdm, kept_eras(cdm, exposed_eras(cdm, spec), spec), spec)


def total_case_counts(cdm, spec: SignalSpec) -> DataFrame:
    return _total(cdm, kept_eras(cdm, eligible_eras(cdm, spec), spec), spec)


def case_total_report(cdm, spec: SignalSpec) -> DataFrame:
    """Cases per drug beside the cases of all drugs. Eligible eras and the
    exclusion are computed once, written, and read by both counts."""
    kept = materialize(kept_eras(cdm, eligible_eras(cdm, spec), spec).select(
        "person_id", "ingredient_name", "drug_era_start_date", "drug_era_end_date"), "kept-eras")
    return _by_drug(cdm, _named(kept, spec), spec).join(_total(cdm, kept, spec), "condition_source_value").select(
        "ingredient_name", "condition_source_value", "case_count", "total_count"
    ).orderBy("ingredient_name", "condition_source_value")
