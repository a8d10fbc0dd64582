"""Train/test splits, folds and samples, reproducible by hashing ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.ranks import hash_fraction, hash_order, row_numbers
from vitalspan.operators.sampling import hashed_sample
from vitalspan.operators.summaries import discrete_percentiles
from vitalspan.session import materialize


@dataclass(frozen=True)
class SplitSpec:
    kind: str = "stratified"  # stratified | subject | time | custom
    test_fraction: float = 0.25
    folds: int = 3
    seed: int = 1
    custom: Callable[[DataFrame], DataFrame] | None = None


def _assign(units: DataFrame, unit: str, spec: SplitSpec) -> DataFrame:
    """Within each class the first share of units in hash order is the test
    set (-1), the rest go round-robin into folds 1..n."""
    hashed = units.withColumn("_h", hash_order(unit, seed=spec.seed))
    ranked = row_numbers(hashed, ["_class"], ["_h"], "_rn")
    sizes = units.groupBy("_class").agg(F.floor(F.count(F.lit(1)) * spec.test_fraction).alias("_test"))
    placed = ranked.join(sizes, "_class")
    fold = (F.col("_rn") - F.col("_test") - 1) % spec.folds + 1
    return placed.select(unit, F.when(F.col("_rn") <= F.col("_test"), -1).otherwise(fold).cast("long").alias("index"))


def split_stratified(population: DataFrame, spec: SplitSpec) -> DataFrame:
    units = population.select("row_id", (F.col("outcome_count") > 0).cast("int").alias("_class"))
    return _assign(units, "row_id", spec)


def split_subject(population: DataFrame, spec: SplitSpec) -> DataFrame:
    """Whole subjects stay on one side; classes by any outcome of the subject."""
    units = population.groupBy("subject_id").agg(F.max((F.col("outcome_count") > 0).cast("int")).alias("_class"))
    return population.select("row_id", "subject_id").join(_assign(units, "subject_id", spec), "subject_id").select("row_id", "index")


def split_time(population: DataFrame, spec: SplitSpec) -> DataFrame:
    """Rows that start after the date quantile are the test set."""
    cut = discrete_percentiles(population, [], "cohort_start_date", {"cut": 1 - spec.test_fraction}).scalar()
    fold = F.floor(hash_fraction("row_id", seed=spec.seed) * spec.folds) + 1
    return population.select(
        "row_id", F.when(F.col("cohort_start_date") > cut, -1).otherwise(fold).cast("long").alias("index"))


def split(population: DataFrame, spec: SplitSpec) -> DataFrame:
    """(row_id, index): below 0 test, above 0 the fold."""
    if spec.kind == "custom":
        out = spec.custom(population)
        return out.select(F.col("row_id"), F.col("index").cast("long").alias("index"))
    return {"stratified": split_stratified, "subject": split_subject, "time": split_time}[spec.kind](population, spec)


def undersample(population: DataFrame, non_outcomes_per_outcome: float, seed: int = 0) -> DataFrame:
    """All outcomes and the first k times as many others in hash order."""
    positive = F.col("outcome_count") > 0
    limit = population.agg(F.floor(F.sum(positive.cast("int")) * non_outcomes_per_outcome)).scalar()
    others = population.filter(~positive).withColumn("_h", hash_order("row_id", seed=seed))
    kept = row_numbers(others, [], ["_h"], "_rn").filter(F.col("_rn") <= limit).drop("_h", "_rn")
    return population.filter(positive).unionByName(kept)


def random_sample_n(labels: DataFrame, members: dict[str, DataFrame], n: int, seed: int = 0) -> dict[str, DataFrame]:
    """The same n rows kept in the labels and every companion frame."""
    chosen = materialize(hashed_sample(labels.select("row_id"), "row_id", n, seed), "sample")
    return {k: f.join(chosen, "row_id", "left_semi") for k, f in {"labels": labels, **members}.items()}


def nested_fraction(population: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Hash-prefix subset: smaller fractions are contained in larger ones."""
    return population.filter(hash_fraction("row_id", seed=seed) < fraction)
