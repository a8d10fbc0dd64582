"""Column layout of the health-record tables the plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table layouts of the record model (name type, in table order).
LAYOUTS = {
    "person": "person_id long, gender_concept_id long, year_of_birth long, month_of_birth long, "
    "day_of_birth long, race_concept_id long, ethnicity_concept_id long",
    "observation_period": "person_id long, observation_period_start_date date, observation_period_end_date date",
    "drug_exposure": "person_id long, drug_concept_id long, drug_exposure_start_date date, "
    "drug_exposure_end_date date, days_supply long",
    "drug_era": "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date, "
    "drug_exposure_count long, gap_days long",
    "condition_occurrence": "person_id long, condition_concept_id long, condition_source_concept_id long, "
    "condition_source_value string, condition_start_date date, visit_occurrence_id long",
    "condition_era": "person_id long, condition_concept_id long, condition_era_start_date date, "
    "condition_era_end_date date",
    "measurement": "person_id long, measurement_concept_id long, measurement_date date, value_as_number double, "
    "unit_concept_id long, range_low double, range_high double, visit_occurrence_id long",
    "visit_occurrence": "visit_occurrence_id long, person_id long, visit_concept_id long, visit_start_date date, "
    "visit_end_date date",
    "procedure_occurrence": "person_id long, procedure_concept_id long, procedure_date date, visit_occurrence_id long",
    "device_exposure": "person_id long, device_concept_id long, device_exposure_start_date date, "
    "device_exposure_end_date date",
    "observation": "person_id long, observation_concept_id long, observation_date date",
    "death": "person_id long, death_date date",
    "concept": "concept_id long, concept_name string, concept_code string, vocabulary_id string, "
    "concept_class_id string, domain_id string, standard_concept string, invalid_reason string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation long",
    "concept_relationship": "concept_id_1 long, concept_id_2 long, relationship_id string, invalid_reason string",
    "cohort": "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(LAYOUTS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast a frame to the table's layout.

    Datetime columns of newer model versions become dates here, so one code
    path serves every version. Missing columns raise.
    """
    have = {c.lower(): c for c in df.columns}
    cols, missing = [], []
    for field in schema_of(table).fields:
        name = field.name
        source = have.get(name) or have.get(name.replace("_date", "_datetime"))
        if source is None:
            missing.append(name)
        else:
            cols.append(F.col(source).cast(field.dataType).alias(name))
    if missing:
        raise ValueError(f"table {table} lacks columns {missing}")
    return df.select(*cols)
