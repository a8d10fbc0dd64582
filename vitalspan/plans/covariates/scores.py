"""Comorbidity scores.

A score needs only the first date a person entered each category, so diagnosis
eras shrink to one row per person and category before they meet the cohort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import age_by_year
from vitalspan.operators.vocab import code_matches, source_code_map
from vitalspan.plans import params as P
from vitalspan.plans.covariates.domain import ROW
from vitalspan.session import literal_frame


def category_concepts(cdm, spec) -> DataFrame:
    """(category, weight, concept) for specs of ancestors, with optional
    excluded ancestors and single extra concepts."""
    spark = cdm.spark
    weights = literal_frame(spark, [(r[0], float(r[2])) for r in spec], "category long, weight double")
    inside = literal_frame(spark, [(r[0], a) for r in spec for a in r[3]], "category long, ancestor_concept_id long")
    ca = cdm.concept_ancestor.select("ancestor_concept_id", F.col("descendant_concept_id").alias("concept_id"))
    concepts = ca.join(inside, "ancestor_concept_id").select("category", "concept_id")
    outside = [(r[0], a) for r in spec if len(r) > 4 for a in r[4]]
    if outside:
        gone = ca.join(
            literal_frame(spark, outside, "category long, ancestor_concept_id long"), "ancestor_concept_id"
        ).select("category", "concept_id")
        concepts = concepts.join(gone, ["category", "concept_id"], "left_anti")
    extra = [(r[0], c) for r in spec if len(r) > 5 for c in r[5]]
    if extra:
        live = cdm.concept.filter(F.col("invalid_reason").isNull()).select("concept_id")
        concepts = concepts.unionByName(
            literal_frame(spark, extra, "category long, concept_id long").join(live, "concept_id", "left_semi")
            .select("category", "concept_id"))
    return concepts.distinct().join(weights, "category")


def _first_entries(cdm, concepts: DataFrame, keys: list[str]) -> DataFrame:
    eras = cdm.condition_era.select(
        "person_id", F.col("condition_concept_id").alias("concept_id"), "condition_era_start_date")
    return eras.join(concepts, "concept_id").groupBy("person_id", *keys).agg(
        F.min("condition_era_start_date").alias("_first"))


def _entered(cohort: DataFrame, entries: DataFrame, end_day: int) -> DataFrame:
    rows = cohort.select(*ROW, F.col("subject_id").alias("person_id"), "cohort_start_date")
    return rows.join(entries, "person_id").filter(F.col("_first") <= F.date_add("cohort_start_date", end_day))


def _score(rows: DataFrame, value: str, analysis_id: int) -> DataFrame:
    return rows.groupBy(*ROW).agg(F.sum(value).alias("covariate_value")).withColumn(
        "covariate_id", F.lit(1000 + analysis_id).cast("long"))


def category_weight_sum(cdm, cohort, spec, analysis_id: int, end_day: int = 0, extra: DataFrame | None = None) -> DataFrame:
    """Each category counts its weight once; ``extra`` adds (row, weight)."""
    entries = _first_entries(cdm, category_concepts(cdm, spec), ["category", "weight"])
    points = _entered(cohort, entries, end_day).select(*ROW, "weight")
    return _score(points if extra is None else points.unionByName(extra), "weight", analysis_id)


def charlson(cdm, cohort, analysis_id: int = 901, end_day: int = 0) -> DataFrame:
    return category_weight_sum(cdm, cohort, P.CHARLSON, analysis_id, end_day)


def _age_points(cdm, cohort, points) -> DataFrame:
    people = cohort.join(cdm.person, F.col("subject_id") == F.col("person_id"))
    return people.select(*ROW, points.cast("double").alias("weight"))


def chads2(cdm, cohort, analysis_id: int = 903, end_day: int = 0) -> DataFrame:
    years = age_by_year("cohort_start_date", "year_of_birth")
    extra = _age_points(cdm, cohort, F.when(years >= 75, 1).otherwise(0))
    return category_weight_sum(cdm, cohort, P.CHADS2, analysis_id, end_day, extra)


def chads2vasc(cdm, cohort, analysis_id: int = 904, end_day: int = 0) -> DataFrame:
    years = age_by_year("cohort_start_date", "year_of_birth")
    by_age = F.when(years >= 75, 2).when(years >= 65, 1).otherwise(0)
    by_gender = F.when(F.col("gender_concept_id") == P.FEMALE, 1).otherwise(0)
    return category_weight_sum(
        cdm, cohort, P.CHADS2VASC, analysis_id, end_day, _age_points(cdm, cohort, by_age + by_gender))


def category_max_sum(cdm, cohort, scored: DataFrame, analysis_id: int, end_day: int = 0) -> DataFrame:
    """The best score of each category, summed. ``scored``: category, score, concept_id."""
    entries = _first_entries(cdm, scored, ["category", "score"])
    best = _entered(cohort, entries, end_day).groupBy(*ROW, "category").agg(F.max("score").alias("score"))
    return _score(best, "score", analysis_id)


def dcsi_concepts(cdm) -> DataFrame:
    codes = source_code_map(cdm.concept, cdm.concept_relationship, "ICD9CM")
    code = F.col("source_code")
    hits = F.array(*[
        F.when(code_matches(code, prefixes, exact, between),
               F.struct(F.lit(category).alias("category"), F.lit(float(score)).alias("score")))
        for category, score, prefixes, exact, between in P.DCSI])
    return codes.select(
        F.col("target_concept_id").alias("concept_id"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")
    ).select("concept_id", "h.category", "h.score").distinct()


def dcsi(cdm, cohort, analysis_id: int = 902, end_day: int = 0) -> DataFrame:
    return category_max_sum(cdm, cohort, dcsi_concepts(cdm), analysis_id, end_day)


def hfrs_concepts(cdm) -> DataFrame:
    codes = source_code_map(cdm.concept, cdm.concept_relationship, "ICD10")
    table = literal_frame(cdm.spark, list(P.HFRS), "category string, score double")
    return codes.join(table, F.substring("source_code", 1, 3) == F.col("category")).select(
        F.col("target_concept_id").alias("concept_id"), "category", "score").distinct()


def hfrs(cdm, cohort, analysis_id: int = 926, end_day: int = 0) -> DataFrame:
    return category_max_sum(cdm, cohort, hfrs_concepts(cdm), analysis_id, end_day)
