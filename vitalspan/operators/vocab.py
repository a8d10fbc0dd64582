"""Concept sets: explicit ids, descendants, groups and source-code maps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.predicates import any_of, filter_concepts, name_like_none
from vitalspan.operators.ranks import first_per_key
from vitalspan.plans import params as P
from vitalspan.session import literal_frame


def expand_descendants(concept_ancestor: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The ids themselves plus all their descendants."""
    ids = list(ids)
    own = literal_frame(concept_ancestor.sparkSession, [(i,) for i in ids], "concept_id long")
    below = filter_concepts(concept_ancestor, "ancestor_concept_id", ids).select(
        F.col("descendant_concept_id").alias("concept_id"))
    return own.unionByName(below).distinct()


def codeset(
    concept_ancestor: DataFrame, ids: Iterable[int], include_descendants: bool = False,
    exclude_ids: Iterable[int] = (), exclude_descendants: bool = True,
) -> DataFrame:
    ids, exclude_ids = list(ids), list(exclude_ids)
    spark = concept_ancestor.sparkSession
    chosen = (
        expand_descendants(concept_ancestor, ids) if include_descendants
        else literal_frame(spark, [(i,) for i in ids], "concept_id long").distinct())
    if not exclude_ids:
        return chosen
    gone = (
        expand_descendants(concept_ancestor, exclude_ids) if exclude_descendants
        else literal_frame(spark, [(i,) for i in exclude_ids], "concept_id long"))
    return chosen.join(gone, "concept_id", "left_anti")


def subset_by_rows(covariates: DataFrame, rows: DataFrame) -> DataFrame:
    return covariates.join(rows.select("row_id").distinct(), "row_id", "left_semi")


def subset_by_cohort(aggregated: DataFrame, cohort_ids: Iterable[int]) -> DataFrame:
    return aggregated.filter(F.col("cohort_definition_id").isin(list(cohort_ids)))


def drug_groups(concept: DataFrame, concept_ancestor: DataFrame, ingredients_only: bool = False) -> DataFrame:
    """(descendant, ancestor) pairs for therapeutic classes and drug concepts."""
    standard = (F.col("standard_concept") == "S") & (F.col("domain_id") == "Drug")
    if ingredients_only:
        standard = standard & (F.col("concept_class_id") == "Ingredient")
    classes = (F.col("vocabulary_id") == "ATC") & F.length("concept_code").isin(list(P.ATC_CODE_LENGTHS))
    groups = concept.filter((classes | standard) & (F.col("concept_id") != 0)).select(
        F.col("concept_id").alias("ancestor_concept_id"))
    return concept_ancestor.join(groups, "ancestor_concept_id", "left_semi").select(
        "descendant_concept_id", "ancestor_concept_id").distinct()


def condition_groups(concept: DataFrame, concept_ancestor: DataFrame) -> DataFrame:
    """(descendant, ancestor) pairs for specific enough condition groups."""
    deep = (F.col("min_levels_of_separation") > 2) | F.col("descendant_concept_id").isin(
        list(P.EXTRA_CONDITION_GROUPS))
    below = concept_ancestor.filter((F.col("ancestor_concept_id") == P.CLINICAL_FINDING) & deep).select(
        F.col("descendant_concept_id").alias("concept_id"))
    valid = concept.filter(
        (F.col("domain_id") == "Condition") & name_like_none("concept_name", P.UNSPECIFIC_GROUP_NAMES)
    ).join(below, "concept_id", "left_semi").select(F.col("concept_id").alias("ancestor_concept_id"))
    return concept_ancestor.join(valid, "ancestor_concept_id", "left_semi").select(
        "descendant_concept_id", "ancestor_concept_id").distinct()


def source_code_map(
    concept: DataFrame, concept_relationship: DataFrame, source_vocabulary: str, target_vocabulary: str = "SNOMED",
    live_only: bool = False,
) -> DataFrame:
    """(source_code, target_concept_id) along 'Maps to' links."""
    source = concept.filter(F.col("vocabulary_id") == source_vocabulary)
    target = concept.filter(F.col("vocabulary_id") == target_vocabulary)
    links = concept_relationship.filter(F.col("relationship_id") == "Maps to")
    if live_only:
        source = source.filter(F.col("invalid_reason").isNull())
        links = links.filter(F.col("invalid_reason").isNull())
    return (
        links.join(source.select(F.col("concept_id").alias("concept_id_1"), F.col("concept_code").alias("source_code")),
                   "concept_id_1")
        .join(target.select(F.col("concept_id").alias("concept_id_2")), "concept_id_2")
        .select("source_code", F.col("concept_id_2").alias("target_concept_id"))
    )


def icd9_number(code) -> object:
    """Three-character ICD9 code as a number: E codes from 1000, V codes from 1100."""
    head, tail = F.substring(code, 1, 1), F.substring(code, 2, 2).cast("long")
    return F.when(head == "E", 1000 + tail).when(head == "V", 1100 + tail).otherwise(
        F.substring(code, 1, 3).cast("long"))


def one_code_per_concept(code_map: DataFrame) -> DataFrame:
    """Keep the first code (in code order) of each target concept."""
    return first_per_key(code_map.select("target_concept_id", "source_code"), ["target_concept_id"], ["source_code"])


def code_matches(code, prefixes, exact=(), between=None):
    parts = [code.startswith(p) for p in prefixes]
    if exact:
        parts.append(code.isin(list(exact)))
    if between:
        parts.append((code >= between[0]) & (code <= between[1]))
    return any_of(parts)
