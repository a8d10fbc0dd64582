"""Drug and condition eras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import days_between, resolve_end
from vitalspan.functions.predicates import is_mapped, supply_not_negative
from vitalspan.operators.intervals import collapse_intervals, collapse_twice
from vitalspan.session import materialize

ERA_KEYS = ["person_id", "drug_concept_id"]


def ingredient_links(concept: DataFrame, concept_ancestor: DataFrame) -> DataFrame:
    """(drug concept, ingredient concept) pairs."""
    ingredient = concept.filter(
        (F.col("vocabulary_id") == "RxNorm") & (F.col("concept_class_id") == "Ingredient")
    ).select(F.col("concept_id").alias("ingredient_concept_id"))
    return concept_ancestor.join(
        ingredient, F.col("ancestor_concept_id") == F.col("ingredient_concept_id")
    ).select(F.col("descendant_concept_id").alias("source_concept_id"), "ingredient_concept_id")


def ingredient_exposures(
    exposure: DataFrame, concept: DataFrame, concept_ancestor: DataFrame, zero_supply: str = "plus_one_day"
) -> DataFrame:
    """Mapped exposures rolled up to ingredients, with a resolved end date."""
    usable = exposure.filter(is_mapped("drug_concept_id") & supply_not_negative("days_supply"))
    ends = resolve_end(
        "drug_exposure_start_date", "drug_exposure_end_date", "days_supply", zero_supply)
    links = ingredient_links(concept, concept_ancestor)
    return usable.join(links, F.col("drug_concept_id") == F.col("source_concept_id")).select(
        "person_id", F.col("ingredient_concept_id").alias("drug_concept_id"),
        F.col("drug_exposure_start_date").alias("start_date"), ends.alias("end_date"),
    )


def sub_exposures(exposures: DataFrame) -> DataFrame:
    """Overlapping exposures of one ingredient merged, no persistence window."""
    return collapse_intervals(
        exposures, ERA_KEYS, "start_date", "end_date", 0, count="drug_exposure_count"
    ).withColumn("days_exposed", days_between("start_date", "end_date").cast("long"))


def drug_era(
    exposure: DataFrame, concept: DataFrame, concept_ancestor: DataFrame,
    persistence_days: int = 30, zero_supply: str = "plus_one_day",
) -> DataFrame:
    """Ingredient eras: sub-exposures merged across the persistence window.

    ``gap_days`` is the era length minus the days its sub-exposures cover.
    Exposures are written, so that the shuffles that bring them together are
    gone when they are shuffled by person.
    """
    exposures = materialize(ingredient_exposures(exposure, concept, concept_ancestor, zero_supply), "exposures")
    eras = collapse_twice(
        exposures, ERA_KEYS, "start_date", "end_date", persistence_days, "drug_exposure_count", "days_exposed")
    return eras.select(
        *ERA_KEYS, F.col("start_date").alias("drug_era_start_date"), F.col("end_date").alias("drug_era_end_date"),
        "drug_exposure_count",
        (days_between("start_date", "end_date") - F.col("days_exposed")).alias("gap_days"),
    )


def condition_eras(condition_occurrence: DataFrame, persistence_days: int = 30) -> DataFrame:
    points = condition_occurrence.select(
        "person_id", "condition_concept_id", F.col("condition_start_date").alias("condition_era_start_date"),
        F.col("condition_start_date").alias("condition_era_end_date"),
    )
    return collapse_intervals(
        points, ["person_id", "condition_concept_id"], "condition_era_start_date", "condition_era_end_date",
        persistence_days,
    )
