"""Covariates from the person table and the index date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import age_by_year, days_between
from vitalspan.operators.ranges import period_of
from vitalspan.plans.covariates.domain import ROW


def _people(cdm, cohort: DataFrame) -> DataFrame:
    return cohort.join(cdm.person, F.col("subject_id") == F.col("person_id"))


def _flag(frame: DataFrame, covariate) -> DataFrame:
    return frame.select(*ROW, covariate.cast("long").alias("covariate_id"), F.lit(1.0).alias("covariate_value"))


def concept_one_hot(cdm, cohort: DataFrame, column: str, analysis_id: int) -> DataFrame:
    """One covariate per concept of a person column; concept 0 is dropped."""
    known = _people(cdm, cohort).filter(F.col(column) != 0)
    return _flag(known, F.col(column) * 1000 + analysis_id)


def gender(cdm, cohort, analysis_id: int = 1) -> DataFrame:
    return concept_one_hot(cdm, cohort, "gender_concept_id", analysis_id)


def race(cdm, cohort, analysis_id: int = 4) -> DataFrame:
    return concept_one_hot(cdm, cohort, "race_concept_id", analysis_id)


def ethnicity(cdm, cohort, analysis_id: int = 5) -> DataFrame:
    return concept_one_hot(cdm, cohort, "ethnicity_concept_id", analysis_id)


def age(cdm, cohort, analysis_id: int = 2) -> DataFrame:
    return _people(cdm, cohort).select(
        *ROW, F.lit(1000 + analysis_id).cast("long").alias("covariate_id"),
        age_by_year("cohort_start_date", "year_of_birth").cast("double").alias("covariate_value"))


def age_group(cdm, cohort, analysis_id: int = 3, years: int = 5) -> DataFrame:
    band = F.floor(age_by_year("cohort_start_date", "year_of_birth") / years)
    return _flag(_people(cdm, cohort), band * 1000 + analysis_id)


def index_year(cdm, cohort, analysis_id: int = 6) -> DataFrame:
    return _flag(cohort, F.year("cohort_start_date") * 1000 + analysis_id)


def index_month(cdm, cohort, analysis_id: int = 7) -> DataFrame:
    return _flag(cohort, F.month("cohort_start_date") * 1000 + analysis_id)


def index_year_month(cdm, cohort, analysis_id: int = 12) -> DataFrame:
    return _flag(cohort, F.year("cohort_start_date") * 100000 + F.month("cohort_start_date") * 1000 + analysis_id)


def _days(frame: DataFrame, value, analysis_id: int) -> DataFrame:
    return frame.select(
        *ROW, F.lit(1000 + analysis_id).cast("long").alias("covariate_id"), value.cast("double").alias("covariate_value"))


def time_prior(cdm, cohort, analysis_id: int = 8) -> DataFrame:
    rows = period_of(cohort, cdm.observation_period, "cohort_start_date", "subject_id")
    return _days(rows, days_between("op_start_date", "cohort_start_date"), analysis_id)


def time_post(cdm, cohort, analysis_id: int = 9) -> DataFrame:
    rows = period_of(cohort, cdm.observation_period, "cohort_start_date", "subject_id")
    return _days(rows, days_between("cohort_start_date", "op_end_date"), analysis_id)


def time_in_cohort(cdm, cohort, analysis_id: int = 10) -> DataFrame:
    return _days(cohort, days_between("cohort_start_date", "cohort_end_date"), analysis_id)


def observation_length_attribute(cdm, cohort: DataFrame, attribute_id: int = 1) -> DataFrame:
    """Cohort attribute: days of observation before the index date."""
    rows = period_of(cohort, cdm.observation_period, "cohort_start_date", "subject_id")
    return rows.select(
        "cohort_definition_id", "subject_id", "cohort_start_date",
        F.lit(attribute_id).cast("long").alias("attribute_definition_id"),
        days_between("op_start_date", "cohort_start_date").cast("double").alias("value_as_number"))


def attribute_covariates(cohort: DataFrame, attributes: DataFrame, include=None) -> DataFrame:
    """Attribute table rows as covariates of the cohort rows they were made
    for; a subject may enter a cohort more than once."""
    keys = ["cohort_definition_id", "subject_id", "cohort_start_date"]
    a = attributes.select(*keys, "attribute_definition_id", "value_as_number")
    if include is not None:
        a = a.filter(F.col("attribute_definition_id").isin(list(include)))
    return cohort.join(a, keys).select(
        *ROW, F.col("attribute_definition_id").alias("covariate_id"), F.col("value_as_number").alias("covariate_value"))
