"""High-dimensional propensity features: code frequencies and thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.eras import ingredient_links
from vitalspan.operators.ranges import band_join
from vitalspan.operators.ranks import running_totals
from vitalspan.operators.vocab import icd9_number, one_code_per_concept, source_code_map
from vitalspan.plans.covariates.domain import ROW
from vitalspan.session import materialize

LOOKBACK_DAYS = 180
INPATIENT = 9201
# Analysis ids (any, frequent by median, frequent by upper quartile).
ANALYSES = {
    "icd9_inpatient": (104, 105, 106),
    "icd9_ambulatory": (107, 108, 109),
    "ingredient": (403, 404, 405),
    "procedure_inpatient": (703, 704, 705),
    "procedure_ambulatory": (706, 707, 708),
}


def icd9_of_conditions(cdm) -> DataFrame:
    """(condition concept, numeric three-character code), one code per concept."""
    codes = source_code_map(cdm.concept, cdm.concept_relationship, "ICD9CM", live_only=True).select(
        "target_concept_id", F.substring("source_code", 1, 3).alias("source_code")).distinct()
    return one_code_per_concept(codes).select(
        F.col("target_concept_id").alias("condition_concept_id"), icd9_number(F.col("source_code")).alias("code"))


def _by_setting(cdm, records: DataFrame, inpatient: bool) -> DataFrame:
    kind = F.col("visit_concept_id") == INPATIENT
    visits = cdm.visit_occurrence.filter(kind if inpatient else ~kind).select("visit_occurrence_id")
    return records.join(visits, "visit_occurrence_id", "left_semi")


def coded_records(cdm, source: str) -> DataFrame:
    """(person_id, code, start_date) records of one feature source."""
    if source.startswith("icd9"):
        r = _by_setting(cdm, cdm.condition_occurrence.filter(F.col("condition_concept_id") != 0), source.endswith("inpatient"))
        r = r.join(icd9_of_conditions(cdm), "condition_concept_id")
        return r.select("person_id", "code", F.col("condition_start_date").alias("start_date"))
    if source == "ingredient":
        r = cdm.drug_exposure.filter(F.col("drug_concept_id") != 0).join(
            ingredient_links(cdm.concept, cdm.concept_ancestor), F.col("drug_concept_id") == F.col("source_concept_id"))
        return r.select(
            "person_id", F.col("ingredient_concept_id").alias("code"), F.col("drug_exposure_start_date").alias("start_date"))
    r = cdm.procedure_occurrence.filter(F.col("procedure_concept_id") != 0)
    r = _by_setting(cdm, r, source.endswith("inpatient"))
    return r.select("person_id", F.col("procedure_concept_id").alias("code"), F.col("procedure_date").alias("start_date"))


def frequencies(cdm, cohort: DataFrame, sources: Sequence[str], days: int = LOOKBACK_DAYS) -> DataFrame:
    """Records per row, source and code in the lookback window; all sources
    share one join."""
    records = reduce(DataFrame.unionByName, [
        coded_records(cdm, s).withColumn("source", F.lit(s)) for s in sources])
    daily = records.groupBy("person_id", "source", "code", "start_date").agg(F.count(F.lit(1)).alias("n"))
    rows = cohort.select(
        *ROW, F.col("subject_id").alias("person_id"), F.date_sub("cohort_start_date", days).alias("_lo"),
        F.col("cohort_start_date").alias("_hi"))
    hit = band_join(rows, daily, ["person_id"], "_lo", "_hi", "start_date", days)
    return hit.groupBy(*ROW, "source", "code").agg(F.sum("n").alias("frequency"))


def thresholds(freq: DataFrame) -> DataFrame:
    """Per source and code the largest frequency at or below the median and
    upper quartile rank; -9999 where even the first rank lies above."""
    keys = ["source", "code"]
    counts = freq.groupBy(*keys, "frequency").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    cum = running_totals(counts, keys, "frequency", ["n"]).join(totals, keys)
    # The lowest rank among rows sharing a frequency decides whether it qualifies.
    rank = (F.col("cum_n") - F.col("n") + 1) / F.col("total")

    def largest(q):
        return F.max(F.when(rank <= q, F.col("frequency")).otherwise(-9999))

    return cum.groupBy(*keys).agg(largest(0.50).alias("median_value"), largest(0.75).alias("q75_value"))


def flags(freq: DataFrame) -> DataFrame:
    """Any use, use at or above the median, use at or above the upper quartile.

    The frequencies feed both the thresholds and the flags, so they are written once.
    """
    freq = materialize(freq, "frequencies")
    joined = freq.join(thresholds(freq), ["source", "code"])
    ids = F.create_map(*[x for s, a in ANALYSES.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in a]))])
    a = ids[F.col("source")]
    f, med, q75 = F.col("frequency"), F.col("median_value"), F.col("q75_value")
    levels = F.array(a[0], F.when((f >= med) & (med > 1), a[1]), F.when((f >= q75) & (q75 > med), a[2]))
    return joined.select(
        *ROW, "code", F.explode(F.filter(levels, lambda i: i.isNotNull())).alias("analysis_id")
    ).select(*ROW, (F.col("code") * 1000 + F.col("analysis_id")).alias("covariate_id"), F.lit(1.0).alias("covariate_value"))


def hdps_covariates(cdm, cohort: DataFrame, sources: Sequence[str] = tuple(ANALYSES)) -> DataFrame:
    """All feature sources; their covariate ids never coincide."""
    return flags(frequencies(cdm, cohort, sources))


def drop_small_counts(covariates: DataFrame, max_dropped: int) -> DataFrame:
    """Remove covariates seen in at most ``max_dropped`` rows."""
    kept = covariates.groupBy("covariate_id").agg(F.count("row_id").alias("_n")).filter(F.col("_n") > max_dropped)
    return covariates.join(kept.select("covariate_id"), "covariate_id", "left_semi")
