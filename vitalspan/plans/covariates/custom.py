"""Study-specific covariates: other cohorts, mapped ages, lab values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import age_by_year
from vitalspan.functions.predicates import filter_concepts
from vitalspan.operators.ranges import band_join, overlap_join
from vitalspan.operators.ranks import first_per_key
from vitalspan.operators.summaries import middle_values
from vitalspan.plans.covariates.domain import ROW


def _with_age(cdm, cohort: DataFrame) -> DataFrame:
    return cohort.join(
        cdm.person.select(F.col("person_id").alias("subject_id"), "year_of_birth"), "subject_id"
    ).withColumn("age", age_by_year("cohort_start_date", "year_of_birth"))


@dataclass(frozen=True)
class CohortCovariate:
    covariate_id: int
    cohort_id: int
    start_day: int = -30
    end_day: int = 0
    value: str = "flag"  # flag | count | age | ln_age
    name: str = "cohort"
    analysis_id: int = 456


def cohort_covariate(cdm, cohort: DataFrame, other: DataFrame, spec: CohortCovariate) -> DataFrame:
    """Membership of another cohort during a window around the index date."""
    rows = cohort.select(
        *ROW, "subject_id", "cohort_start_date", F.date_add("cohort_start_date", spec.start_day).alias("_lo"),
        F.date_add("cohort_start_date", spec.end_day).alias("_hi"))
    spans = other.filter(F.col("cohort_definition_id") == spec.cohort_id).select(
        "subject_id", F.col("cohort_start_date").alias("_start"), F.col("cohort_end_date").alias("_end")).distinct()
    hit = overlap_join(rows, spans, ["subject_id"], "_lo", "_hi", "_start", "_end", spec.end_day - spec.start_day + 1)
    per_row = hit.groupBy(*ROW, "subject_id", "cohort_start_date").agg(F.countDistinct("_start").alias("_n"))
    if spec.value in ("age", "ln_age"):
        aged = _with_age(cdm, per_row)
        value = F.log(F.col("age").cast("double")) if spec.value == "ln_age" else F.col("age").cast("double")
        per_row, value = aged, value
    else:
        value = F.col("_n").cast("double") if spec.value == "count" else F.lit(1.0)
    return per_row.select(*ROW, F.lit(spec.covariate_id).cast("long").alias("covariate_id"), value.alias("covariate_value"))


def age_map_covariate(cdm, cohort: DataFrame, mapping: Callable[[Column], Column], covariate_id: int = 1458) -> DataFrame:
    """Age at index passed through a column function (or a pandas UDF)."""
    aged = _with_age(cdm, cohort)
    return aged.select(
        *ROW, F.lit(covariate_id).cast("long").alias("covariate_id"),
        mapping(F.col("age").cast("double")).alias("covariate_value"))


@dataclass(frozen=True)
class MeasurementCovariate:
    concepts: tuple[int, ...]
    covariate_id: int = 1466
    start_day: int = -30
    end_day: int = 0
    reduce: str = "recent"  # max | min | mean | median | recent
    imputation: float = 0.0
    age_interaction: bool = False
    ln_age_interaction: bool = False
    ln_value: bool = False
    scale: Callable[[Column], Column] | None = None
    analysis_id: int = 466
    name: str = "measurement"


def _factor(spec: MeasurementCovariate) -> Column:
    if spec.ln_age_interaction:
        return F.log(F.col("age").cast("double"))
    return F.col("age").cast("double") if spec.age_interaction else F.lit(1.0)


def measurement_rows(cdm, cohort: DataFrame, spec: MeasurementCovariate) -> DataFrame:
    """Non-null values in the window with their distance from the index date,
    one row per value and day (``n`` counts repeats)."""
    m = filter_concepts(cdm.measurement, "measurement_concept_id", spec.concepts).filter(F.col("value_as_number").isNotNull())
    if spec.ln_value:
        m = m.filter(F.col("value_as_number") > 0)
    daily = m.groupBy(
        F.col("person_id").alias("subject_id"), "measurement_date", F.col("value_as_number").alias("raw_value"),
    ).agg(F.count(F.lit(1)).alias("n"))
    rows = _with_age(cdm, cohort).select(
        *ROW, "subject_id", "cohort_start_date", "age", F.date_add("cohort_start_date", spec.start_day).alias("_lo"),
        F.date_add("cohort_start_date", spec.end_day).alias("_hi"))
    hit = band_join(rows, daily, ["subject_id"], "_lo", "_hi", "measurement_date", spec.end_day - spec.start_day)
    base = F.log("raw_value") if spec.ln_value else F.col("raw_value")
    value = _factor(spec) * base
    if spec.scale is not None:
        value = spec.scale(value)
    return hit.select(
        *ROW, "raw_value", "n", value.alias("value"), F.abs(F.datediff("measurement_date", "cohort_start_date")).alias("index_time"))


def reduce_values(rows: DataFrame, how: str) -> DataFrame:
    """One (covariate_value, source_value) per row. Weighted by ``n``."""
    n = F.col("n")

    def mean(c):
        return F.sum(F.col(c) * n) / F.sum(n)

    if how == "recent":
        near = rows.groupBy(*ROW).agg(F.min("index_time").alias("index_time"))
        rows = rows.join(near, [*ROW, "index_time"], "left_semi")
        how = "mean"
    if how == "median":
        return middle_values(rows, ROW, {"covariate_value": "value", "source_value": "raw_value"}, "n")
    pick = {"max": lambda c: F.max(c), "min": lambda c: F.min(c), "mean": mean}[how]
    return rows.groupBy(*ROW).agg(pick("value").alias("covariate_value"), pick("raw_value").alias("source_value"))


def impute_missing(cdm, cohort: DataFrame, reduced: DataFrame, spec: MeasurementCovariate) -> DataFrame:
    """Rows without a value get the (transformed) imputation value."""
    value = F.log(F.lit(float(spec.imputation))) if spec.ln_value else F.lit(float(spec.imputation))
    missing = _with_age(cdm, cohort).join(reduced.select(*ROW), ROW, "left_anti")
    return missing.select(*ROW, (value * _factor(spec)).alias("covariate_value"))


def _as_covariate(frame: DataFrame, covariate_id: int) -> DataFrame:
    return frame.select(*ROW, F.lit(covariate_id).cast("long").alias("covariate_id"), "covariate_value")


def measurement_covariate(cdm, cohort: DataFrame, spec: MeasurementCovariate) -> DataFrame:
    reduced = reduce_values(measurement_rows(cdm, cohort, spec), spec.reduce)
    both = reduced.select(*ROW, "covariate_value").unionByName(impute_missing(cdm, cohort, reduced, spec))
    return _as_covariate(both, spec.covariate_id)


def table1_measure(reduced: DataFrame, covariate_id: int) -> DataFrame:
    """Mean, sd and count of the untransformed values."""
    return reduced.agg(
        F.avg("source_value").alias("mean_value"), F.stddev_samp("source_value").alias("sd_value"),
        F.count(F.lit(1)).alias("n")).withColumn("covariate_id", F.lit(covariate_id).cast("long"))


def measurement_cohort_covariate(
    cdm, cohort: DataFrame, other: DataFrame, cohort_id: int, spec: MeasurementCovariate, side: str = "in",
) -> DataFrame:
    """The same reduction restricted to subjects inside (or outside) another
    cohort during the window; nothing is imputed."""
    rows = cohort.select(
        "subject_id", F.date_add("cohort_start_date", spec.start_day).alias("_lo"),
        F.date_add("cohort_start_date", spec.end_day).alias("_hi")).distinct()
    spans = other.filter(F.col("cohort_definition_id") == cohort_id).select(
        "subject_id", F.col("cohort_start_date").alias("_start"), F.col("cohort_end_date").alias("_end"))
    members = overlap_join(
        rows, spans, ["subject_id"], "_lo", "_hi", "_start", "_end", spec.end_day - spec.start_day + 1
    ).select("subject_id").distinct()
    chosen = cohort.join(members, "subject_id", "left_semi" if side == "in" else "left_anti")
    reduced = reduce_values(measurement_rows(cdm, chosen, spec), spec.reduce)
    return _as_covariate(reduced, spec.covariate_id)


def most_recent(records: DataFrame, keys: list[str], distance: str) -> DataFrame:
    """The single nearest record per key."""
    return first_per_key(records, keys, [distance])
