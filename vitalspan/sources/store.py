"""Persistent results: cohort tables, covariate sets, statistics, result store."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.operators.ranks import dense_ids
from vitalspan.session import literal_frame
from vitalspan.sources.snapshots import Snapshots, delete_folder, folder_names

COHORT_SET_COLUMNS = (("cohort_id", "cohort_name"), ("id", "name"))


def read_cohort_set(spark: SparkSession, path: str) -> DataFrame:
    """Cohort settings (id, name) from CSV; both column spellings are read
    by header, anything else is rejected."""
    header = spark.read.option("header", True).csv(path)
    have = {c.strip().lower(): c for c in header.columns}
    for cid, name in COHORT_SET_COLUMNS:
        if cid in have and name in have:
            return header.select(
                F.col(have[cid]).cast("long").alias("cohort_definition_id"),
                F.trim(F.col(have[name])).alias("cohort_name"))
    raise ValueError(f"cohort settings need columns {COHORT_SET_COLUMNS[0]}, found {header.columns}")


_POINTER = "cohort_definition_id long, version string"


def _pointer(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, f"{path}/current", _POINTER)


def upsert_cohorts(cohorts: DataFrame, path: str, ids: Iterable[int]) -> None:
    """Idempotent replace: the rows of all ``ids`` go, then those of
    ``cohorts`` are the definition's; other definitions stay.

    Rows are written into a new version folder first; then the pointer from
    definitions to versions is replaced in one step. ``cohorts`` may read the
    same store, readers see all of a change or nothing of it, and a run that
    dies leaves the old rows in place. An id without rows leaves none behind.
    Versions that neither the new pointer nor the one before names are deleted.
    """
    spark, ids = cohorts.sparkSession, sorted(set(ids))
    if cohorts.filter(~F.col("cohort_definition_id").isin(ids) | F.col("cohort_definition_id").isNull()).limit(1).count():
        raise ValueError("rows of definitions that are not replaced")
    pointer = _pointer(spark, path)
    before = pointer.current()
    version = f"{before + 1:09d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/rows/version={version}"
    (
        cohorts.select("subject_id", "cohort_start_date", "cohort_end_date", F.col("cohort_definition_id").cast("long").alias("cohort_definition_id"))
        .write.partitionBy("cohort_definition_id").parquet(folder)
    )
    written = [int(n.split("=")[1]) for n in folder_names(spark, folder) if n.startswith("cohort_definition_id=")]
    kept = pointer.read(before).filter(~F.col("cohort_definition_id").isin(ids))
    kept = kept.unionByName(literal_frame(spark, [(i, version) for i in written], _POINTER))
    after = pointer.commit(kept, before)
    named = {r["version"] for n in (before, after) for r in pointer.read(n).select("version").distinct().collect()}
    for name in folder_names(spark, f"{path}/rows"):
        old = name.removeprefix("version=")
        # versions of the same or a later number may belong to a run at work
        if old not in named and int(old.split("-")[0]) <= before:
            delete_folder(spark, f"{path}/rows/{name}")


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of all definitions."""
    columns = "subject_id long, cohort_start_date date, cohort_end_date date"
    pointer = _pointer(spark, path).read()
    if not folder_names(spark, f"{path}/rows"):
        return literal_frame(spark, [], f"cohort_definition_id long, {columns}")
    rows = spark.read.schema(f"{columns}, version string, cohort_definition_id long").parquet(f"{path}/rows")
    # folders of older versions are not listed: they may go while this is read
    versions = [r["version"] for r in pointer.select("version").distinct().collect()]
    return rows.filter(F.col("version").isin(versions)).join(pointer, ["cohort_definition_id", "version"], "left_semi").select(
        "cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date")


@dataclass
class CovariateData:
    """Sparse covariates with their reference tables."""

    covariates: DataFrame
    covariate_ref: DataFrame | None = None
    analysis_ref: DataFrame | None = None
    covariates_continuous: DataFrame | None = None

    def replace(self, **changes) -> "CovariateData":
        return CovariateData(**({f.name: getattr(self, f.name) for f in fields(self)} | changes))


def save_members(members: dict[str, DataFrame | None], path: str) -> None:
    for name, df in members.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_covariates(data: CovariateData, path: str) -> None:
    save_members({f.name: getattr(data, f.name) for f in fields(data)}, path)


def load_covariates(spark: SparkSession, path: str, members: tuple[str, ...]) -> CovariateData:
    return CovariateData(**{m: spark.read.parquet(f"{path}/{m}") for m in members})


def export_csv(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def mask_small_counts(df: DataFrame, columns: list[str], min_count: int) -> DataFrame:
    """Suppress counts strictly between 0 and ``min_count`` as NULL."""
    return df.select(*[
        F.when((F.col(c) > 0) & (F.col(c) < min_count), F.lit(None)).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c) for c in df.columns
    ])


def surrogate_keys(facts: DataFrame, natural: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Split a settings dimension off a fact table.

    Returns (dimension with ``key`` and the natural columns, facts with the
    natural columns replaced by ``key``). Ids follow the order of a digest of
    the settings, so re-runs give the same ids for the same set.
    """
    digest = F.md5(F.to_json(F.struct(*natural)))
    tagged = facts.withColumn("_digest", digest)
    ids = dense_ids(tagged, "_digest", key)
    dimension = tagged.select("_digest", *natural).distinct().join(ids, "_digest").select(key, *natural)
    linked = tagged.join(ids, "_digest").drop("_digest", *natural)
    return dimension, linked


# Tables and columns of the result store.
RESULT_TABLES = {
    "cohorts": "cohort_id int, cohort_definition_id int, cohort_name string",
    "cohort_definition": "cohort_definition_id int, cohort_name string, description string, json string, sql_command string",
    "database_details": "database_id int, database_meta_data_id string",
    "database_meta_data": "database_id string, cdm_source_name string, cdm_source_abbreviation string, cdm_holder string, source_description string, source_documentation_reference string, cdm_etl_reference string, source_release_date string, cdm_release_date string, cdm_version string, vocabulary_version string, max_obs_period_end_date string",
    "tars": "tar_id int, tar_start_day int, tar_start_anchor string, tar_end_day int, tar_end_anchor string",
    "population_settings": "population_setting_id int, population_settings_json string",
    "covariate_settings": "covariate_setting_id int, covariate_settings_json string",
    "model_settings": "model_setting_id int, model_type string, model_settings_json string",
    "split_settings": "split_setting_id int, split_settings_json string",
    "plp_data_settings": "plp_data_setting_id int, plp_data_settings_json string",
    "feature_engineering_settings": "feature_engineering_setting_id int, feature_engineering_settings_json string",
    "tidy_covariates_settings": "tidy_covariates_setting_id int, tidy_covariates_settings_json string",
    "sample_settings": "sample_setting_id int, sample_settings_json string",
    "model_designs": "model_design_id int, target_id int, outcome_id int, tar_id int, plp_data_setting_id int, population_setting_id int, model_setting_id int, covariate_setting_id int, sample_setting_id int, split_setting_id int, feature_engineering_setting_id int, tidy_covariates_setting_id int",
    "diagnostics": "diagnostic_id int, model_design_id int, database_id int",
    "diagnostic_summary": "diagnostic_id int, probast_id string, result_value string",
    "diagnostic_predictors": "diagnostic_id int, days_to_event int, outcome_at_time int, observed_at_start_of_day bigint, probast_id string, input_type string",
    "diagnostic_participants": "diagnostic_id int, design string, metric string, value double, probast_id string",
    "diagnostic_outcomes": "diagnostic_id int, xvalue int, outcome_percent double, aggregation string, probast_id string, input_type string",
    "diagnostic_designs": "diagnostic_id int, probast_id string, value string",
    "models": "model_id int, analysis_id string, model_design_id int, database_id int, model_type string, plp_model_file string, train_details string, preprocessing string, training_time string, intercept double",
    "recalibrations": "recalibration_id int, original_model_id int, recalibrated_model_id int, recalibration_type string, recalibration_json string",
    "performances": "performance_id int, model_design_id int, development_database_id int, validation_database_id int, target_id int, outcome_id int, tar_id int, plp_data_setting_id int, population_setting_id int, model_development int, execution_date_time timestamp, plp_version string",
    "attrition": "performance_id int, outcome_id int, description string, target_count int, unique_people int, outcomes int",
    "prediction_distribution": "performance_id int, evaluation string, class_label int, person_count int, average_predicted_probability double, st_dev_predicted_probability double, min_predicted_probability double, p_05_predicted_probability double, p_25_predicted_probability double, median_predicted_probability double, p_75_predicted_probability double, p_95_predicted_probability double, max_predicted_probability double",
    "covariate_summary": "performance_id int, covariate_id bigint, covariate_name string, concept_id int, covariate_value double, covariate_count int, covariate_mean double, covariate_st_dev double, with_no_outcome_covariate_count int, with_no_outcome_covariate_mean double, with_no_outcome_covariate_st_dev double, with_outcome_covariate_count int, with_outcome_covariate_mean double, with_outcome_covariate_st_dev double, standardized_mean_diff double",
    "threshold_summary": "performance_id int, evaluation string, prediction_threshold double, preference_threshold double, positive_count int, negative_count int, true_count int, false_count int, true_positive_count int, true_negative_count int, false_positive_count int, false_negative_count int, f_1_score double, accuracy double, sensitivity double, false_negative_rate double, false_positive_rate double, specificity double, positive_predictive_value double, false_discovery_rate double, negative_predictive_value double, false_omission_rate double, positive_likelihood_ratio double, negative_likelihood_ratio double, diagnostic_odds_ratio double",
    "calibration_summary": "performance_id int, evaluation string, prediction_threshold double, person_count_at_risk int, person_count_with_outcome int, average_predicted_probability double, st_dev_predicted_probability double, min_predicted_probability double, p_25_predicted_probability double, median_predicted_probability double, p_75_predicted_probability double, max_predicted_probability double, observed_incidence double",
    "evaluation_statistics": "performance_id int, evaluation string, metric string, value double",
    "demographic_summary": "performance_id int, evaluation string, age_group string, gen_group string, person_count_at_risk int, person_count_with_outcome int, average_predicted_probability double, st_dev_predicted_probability double, min_predicted_probability double, p_25_predicted_probability double, p_50_predicted_probability double, p_75_predicted_probability double, max_predicted_probability double",
}


def write_result(df: DataFrame, table: str, path: str, fmt: str = "parquet") -> None:
    """Append rows to one store table; absent columns become NULL."""
    have = set(df.columns)
    fields_ = [f.strip().split(" ") for f in RESULT_TABLES[table].split(",")]
    unknown = have - {n for n, _ in fields_}
    if unknown:
        raise ValueError(f"{table} has no columns {sorted(unknown)}")
    shaped = df.select(*[
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields_])
    writer = shaped.write.mode("append")
    writer.option("header", True).csv(f"{path}/{table}") if fmt == "csv" else writer.parquet(f"{path}/{table}")


def read_result(spark: SparkSession, table: str, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(RESULT_TABLES[table])
    return reader.option("header", True).csv(f"{path}/{table}") if fmt == "csv" else reader.parquet(f"{path}/{table}")
