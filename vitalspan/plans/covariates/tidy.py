"""Tidying, characteristics tables and standardized differences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.session import materialize


@dataclass
class TidyState:
    """What training kept: apply it unchanged to any new data."""

    kept: DataFrame  # covariate_id, max_value

    def apply(self, covariates: DataFrame, normalize: bool = True) -> DataFrame:
        joined = covariates.join(self.kept, "covariate_id")
        value = F.col("covariate_value") / F.col("max_value") if normalize else F.col("covariate_value")
        return joined.select(*[c for c in covariates.columns if c != "covariate_value"], value.alias("covariate_value"))


def covariate_stats(covariates: DataFrame) -> DataFrame:
    """Per covariate: rows, largest value and whether all values are equal."""
    return covariates.groupBy("covariate_id").agg(
        F.count(F.lit(1)).alias("cnt"), F.max("covariate_value").alias("max_value"),
        (F.min("covariate_value") == F.max("covariate_value")).alias("constant"),
    ).withColumn("analysis_id", F.pmod("covariate_id", F.lit(1000)))


def redundant_ids(stats: DataFrame, size) -> DataFrame:
    """Covariates constant over all rows, and the most prevalent member of
    every analysis whose binary covariates together cover everyone once."""
    constant = stats.filter(F.col("constant") & (F.col("cnt") == size)).select("covariate_id", "analysis_id")
    binary = stats.filter(F.col("constant") & (F.col("max_value") == 1) & F.col("single"))
    cover = binary.groupBy("analysis_id").agg(
        F.sum("cnt").alias("_total"),
        F.max(F.struct("cnt", (-F.col("covariate_id")).alias("neg"))).alias("_top"))
    groups = cover.filter(F.col("_total") == size).select((-F.col("_top.neg")).alias("covariate_id"), "analysis_id")
    return constant.unionByName(groups).distinct()


def tidy(
    covariates: DataFrame, population: DataFrame, min_fraction: float = 0.001, normalize: bool = True,
    remove_redundant: bool = True,
) -> tuple[DataFrame, TidyState]:
    """Remove redundant, then infrequent covariates, then scale by the maximum.

    Analyses that lost a redundant covariate are exempt from the frequency
    rule. Totals stay scalar subqueries; only per-covariate rows are joined.
    """
    covariates = materialize(covariates, "covariates")
    size = population.agg(F.count(F.lit(1))).scalar()
    stats = covariate_stats(covariates)
    # An analysis partitions the rows when no row carries two of its covariates.
    per_row = covariates.groupBy(
        "row_id", F.pmod("covariate_id", F.lit(1000)).alias("analysis_id")).agg(F.count(F.lit(1)).alias("_k"))
    single = per_row.groupBy("analysis_id").agg((F.max("_k") == 1).alias("single"))
    stats = stats.join(single, "analysis_id")
    kept = stats
    if remove_redundant:
        gone = redundant_ids(stats, size)
        kept = kept.join(gone.select("covariate_id"), "covariate_id", "left_anti")
        touched = gone.select("analysis_id", F.lit(True).alias("_touched")).distinct()
        kept = kept.join(touched, "analysis_id", "left")
    else:
        kept = kept.withColumn("_touched", F.lit(None).cast("boolean"))
    frequent = (F.col("cnt") / size >= min_fraction) | F.col("_touched").isNotNull()
    state = TidyState(kept.filter(frequent).select("covariate_id", "max_value"))
    return state.apply(covariates, normalize), state


def table1(aggregated: DataFrame, sections: Sequence[tuple[str, int]], cohorts: Sequence[int]) -> DataFrame:
    """Percent of each cohort per covariate, by section (name, analysis id)."""
    section = F.lit(None).cast("string")
    for name, analysis in sections:
        section = F.when(F.pmod("covariate_id", F.lit(1000)) == analysis, F.lit(name)).otherwise(section)
    wide = aggregated.withColumn("section", section).filter(F.col("section").isNotNull())
    return wide.groupBy("section", "covariate_id").agg(*[
        F.max(F.when(F.col("cohort_definition_id") == c, F.col("average_value") * 100)).alias(f"pct_{c}") for c in cohorts])


def standardized_difference(m1, m2, v1, v2):
    spread = F.sqrt((v1 + v2) / 2)
    return F.when(spread > 0, (m1 - m2) / spread)


def binary_differences(aggregated: DataFrame, first: int, second: int) -> DataFrame:
    """Standardized differences of binary covariates between two cohorts; a
    covariate one cohort lacks has mean 0 there."""
    def mean(c):
        return F.coalesce(F.max(F.when(F.col("cohort_definition_id") == c, F.col("average_value"))), F.lit(0.0))

    both = aggregated.filter(F.col("cohort_definition_id").isin(first, second)).groupBy("covariate_id").agg(
        mean(first).alias("mean_1"), mean(second).alias("mean_2"))
    m1, m2 = F.col("mean_1"), F.col("mean_2")
    return both.withColumn("std_diff", standardized_difference(m1, m2, m1 * (1 - m1), m2 * (1 - m2)))


def continuous_differences(aggregated: DataFrame, first: int, second: int) -> DataFrame:
    sides = [
        aggregated.filter(F.col("cohort_definition_id") == c).select(
            "covariate_id", F.col("average_value").alias(f"mean_{i}"), F.col("standard_deviation").alias(f"sd_{i}"))
        for i, c in ((1, first), (2, second))
    ]
    both = sides[0].join(sides[1], "covariate_id")
    return both.withColumn("std_diff", standardized_difference(
        F.col("mean_1"), F.col("mean_2"), F.col("sd_1") ** 2, F.col("sd_2") ** 2))


def top_differences(differences: DataFrame, n: int) -> DataFrame:
    """The n largest absolute differences, ranked. The limit runs as a top-n
    per partition, so the ranking window only sees n rows."""
    size = F.round(F.abs("std_diff"), 9)
    top = differences.orderBy(size.desc_nulls_last(), "covariate_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(size.desc_nulls_last(), "covariate_id")))
