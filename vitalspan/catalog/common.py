"""Condition flags: the smallest covariate build, used by stores and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.plans.covariates.domain import DomainAnalysis, aggregate_flags, domain_flags


def condition_flags(cdm, start_day: int, end_day: int, analysis_id: int) -> DataFrame:
    return domain_flags(cdm, cdm.cohort_rows, DomainAnalysis("condition_occurrence", analysis_id, start_day, end_day))


def condition_counts(cdm, start_day: int, end_day: int, analysis_id: int) -> DataFrame:
    return aggregate_flags(condition_flags(cdm, start_day, end_day, analysis_id), cdm.cohort_rows).select(
        "cohort_definition_id", "covariate_id", F.col("sum_value"))
