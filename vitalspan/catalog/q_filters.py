"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.registry import query
from vitalspan.functions import dates as D
from vitalspan.functions import predicates as X
from vitalspan.operators.ranges import period_of
from vitalspan.operators.vocab import expand_descendants, subset_by_cohort, subset_by_rows
from vitalspan.plans import params as P
from vitalspan.sources.derived import with_row_id

_EXP = "person_id:l drug_concept_id:l start:d end_date:d"


@query(
    "end_date_resolve", "rule:s person_id:l drug_concept_id:l start_date:d end_date:d",
    """SELECT 'plus_one_day' AS rule, person_id, drug_concept_id, drug_exposure_start_date AS start_date,
      COALESCE(drug_exposure_end_date, CASE WHEN days_supply > 0 THEN drug_exposure_start_date + days_supply END, drug_exposure_start_date + 1) AS end_date FROM drug_exposure
      UNION ALL SELECT 'same_day', person_id, drug_concept_id, drug_exposure_start_date,
      COALESCE(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) FROM drug_exposure""",
)
def _(cdm):
    def variant(rule):
        return cdm.drug_exposure.select(
            F.lit(rule).alias("rule"), "person_id", "drug_concept_id", F.col("drug_exposure_start_date").alias("start_date"),
            D.resolve_end("drug_exposure_start_date", "drug_exposure_end_date", "days_supply", rule).alias("end_date"))

    return variant("plus_one_day").unionByName(variant("same_day"))


@query(
    "unmapped_filter", "person_id:l drug_concept_id:l days_supply:l",
    "SELECT person_id, drug_concept_id, days_supply FROM drug_exposure WHERE drug_concept_id <> 0 AND COALESCE(days_supply, 0) >= 0",
)
def _(cdm):
    return cdm.drug_exposure.filter(X.is_mapped("drug_concept_id") & X.supply_not_negative("days_supply"))


_SHORT_LIST = [4000000 + i for i in (1, 4, 9, 16)]
_LONG_LIST = list(range(2000000, 2002000, 1))


@query(
    "concept_in_list", "source:s concept_id:l records:l",
    f"""SELECT 'condition' AS source, condition_concept_id AS concept_id, count(*) AS records FROM condition_occurrence WHERE condition_concept_id IN ({', '.join(map(str, _SHORT_LIST))}) GROUP BY 2
      UNION ALL SELECT 'drug', drug_concept_id, count(*) FROM drug_exposure WHERE drug_concept_id BETWEEN 2000000 AND 2001999 GROUP BY 2""",
)
def _(cdm):
    few = X.filter_concepts(cdm.condition_occurrence, "condition_concept_id", _SHORT_LIST)
    many = X.filter_concepts(cdm.drug_exposure, "drug_concept_id", _LONG_LIST)

    def count(df, source, c):
        return df.groupBy(F.col(c).alias("concept_id")).agg(F.count(F.lit(1)).alias("records")).withColumn(
            "source", F.lit(source))

    return count(few, "condition", "condition_concept_id").unionByName(count(many, "drug", "drug_concept_id"))


def _like_any(column: str, parts, form: str) -> str:
    return "(" + " OR ".join(f"{column} LIKE '{form.format(p)}'" for p in parts) + ")"


@query(
    "name_contains_any", "concept_id:l concept_name:s",
    f"SELECT concept_id, concept_name FROM concept WHERE {_like_any('lower(concept_name)', P.LIVER_SIGNAL_DRUGS + ('ring',), '%{}%')}",
)
def _(cdm):
    return cdm.concept.filter(X.name_contains_any("concept_name", P.LIVER_SIGNAL_DRUGS + ("ring",)))


@query(
    "code_prefix_any", "person_id:l condition_source_value:s condition_start_date:d",
    f"SELECT person_id, condition_source_value, condition_start_date FROM condition_occurrence WHERE {_like_any('upper(condition_source_value)', P.KIDNEY_SIGNAL_PRIOR + P.LIVER_SIGNAL_OUTCOME, '{}%')}",
)
def _(cdm):
    return cdm.condition_occurrence.filter(
        X.code_prefix_any("condition_source_value", P.KIDNEY_SIGNAL_PRIOR + P.LIVER_SIGNAL_OUTCOME))


@query(
    "name_not_like", "concept_id:l concept_name:s",
    f"SELECT concept_id, concept_name FROM concept WHERE domain_id = 'Condition' AND NOT {_like_any('concept_name', P.UNSPECIFIC_GROUP_NAMES, '{}')}",
)
def _(cdm):
    return cdm.concept.filter((F.col("domain_id") == "Condition") & X.name_like_none("concept_name", P.UNSPECIFIC_GROUP_NAMES))


@query(
    "ratio_to_limit", "person_id:l measurement_concept_id:l measurement_date:d ratio:f",
    "SELECT person_id, measurement_concept_id, measurement_date, value_as_number / NULLIF(range_high, 0) AS ratio FROM measurement WHERE value_as_number / NULLIF(range_high, 0) > 2",
)
def _(cdm):
    ratio = X.ratio_to_limit("value_as_number", "range_high")
    return cdm.measurement.filter(ratio > 2).withColumn("ratio", ratio)


@query(
    "absolute_threshold", "rule:s measurement_concept_id:l records:l",
    f"""SELECT 'above' AS rule, measurement_concept_id, count(*) AS records FROM measurement WHERE measurement_concept_id = {P.CREATININE} AND value_as_number > 1.2 GROUP BY 2
      UNION ALL SELECT 'below', measurement_concept_id, count(*) FROM measurement WHERE measurement_concept_id = {P.CREATININE} AND value_as_number < 1.2 GROUP BY 2
      UNION ALL SELECT 'normal', measurement_concept_id, count(*) FROM measurement WHERE value_as_number <= range_high GROUP BY 2""",
)
def _(cdm):
    m = cdm.measurement
    creatinine = F.col("measurement_concept_id") == P.CREATININE
    rules = {
        "above": creatinine & X.compare(F.col("value_as_number"), ">", 1.2),
        "below": creatinine & X.compare(F.col("value_as_number"), "<", 1.2),
        "normal": X.compare(F.col("value_as_number"), "<=", F.col("range_high")),
    }
    tagged = m.select("measurement_concept_id", F.explode(F.filter(
        F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())).alias("rule"))
    return tagged.groupBy("rule", "measurement_concept_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    "range_group", "measurement_concept_id:l grp:l records:l",
    """SELECT measurement_concept_id, CASE WHEN value_as_number < range_low THEN 1 WHEN value_as_number > range_high THEN 3 ELSE 2 END AS grp, count(*) AS records
       FROM measurement WHERE range_low IS NOT NULL AND range_high IS NOT NULL GROUP BY 1, 2""",
)
def _(cdm):
    m = cdm.measurement.filter(F.col("range_low").isNotNull() & F.col("range_high").isNotNull())
    return m.groupBy("measurement_concept_id", X.range_group("value_as_number", "range_low", "range_high").alias("grp")).agg(
        F.count(F.lit(1)).alias("records"))


def _cohort_person(cdm):
    return cdm.cohort_rows.join(cdm.person, F.col("subject_id") == F.col("person_id"))


@query(
    "age_year_diff", "row_id:l age:l",
    "SELECT row_id, year(cohort_start_date) - year_of_birth AS age FROM cohort_rows JOIN person ON subject_id = person_id",
)
def _(cdm):
    return _cohort_person(cdm).select("row_id", D.age_by_year("cohort_start_date", "year_of_birth").alias("age"))


_EXACT = "(date_diff('day', make_date(year_of_birth, month_of_birth, day_of_birth), cohort_start_date) // 365)"


@query(
    "age_exact_days", "row_id:l age:l",
    f"SELECT row_id, {_EXACT} AS age FROM cohort_rows JOIN person ON subject_id = person_id",
)
def _(cdm):
    return _cohort_person(cdm).select("row_id", D.age_by_days(
        "cohort_start_date", "year_of_birth", "month_of_birth", "day_of_birth").alias("age"))


@query(
    "age_filter", "rule:s row_id:l",
    f"""SELECT 'at_most_65' AS rule, row_id FROM cohort_rows JOIN person ON subject_id = person_id WHERE {_EXACT} <= 65
      UNION ALL SELECT 'at_least_18', row_id FROM cohort_rows JOIN person ON subject_id = person_id WHERE {_EXACT} >= 18
      UNION ALL SELECT 'over_40', row_id FROM cohort_rows JOIN person ON subject_id = person_id WHERE year(cohort_start_date) - year_of_birth > 40""",
)
def _(cdm):
    rows = _cohort_person(cdm)
    exact = D.age_by_days("cohort_start_date", "year_of_birth", "month_of_birth", "day_of_birth")
    rules = {"at_most_65": exact <= 65, "at_least_18": exact >= 18,
             "over_40": D.age_by_year("cohort_start_date", "year_of_birth") > 40}
    return rows.select("row_id", F.explode(F.filter(
        F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())).alias("rule"))


@query(
    "gender_filter", "row_id:l subject_id:l",
    f"SELECT row_id, subject_id FROM cohort_rows WHERE subject_id IN (SELECT person_id FROM person WHERE gender_concept_id IN ({P.MALE}))",
)
def _(cdm):
    male = cdm.person.filter(F.col("gender_concept_id").isin(P.MALE)).select(F.col("person_id").alias("subject_id"))
    return cdm.cohort_rows.join(male, "subject_id", "left_semi")


@query(
    "exposure_days", "inclusive:b person_id:l drug_concept_id:l drug_era_start_date:d days:l",
    """SELECT TRUE AS inclusive, person_id, drug_concept_id, drug_era_start_date, date_diff('day', drug_era_start_date, drug_era_end_date) + 1 AS days FROM drug_era WHERE date_diff('day', drug_era_start_date, drug_era_end_date) + 1 >= 7
      UNION ALL SELECT FALSE, person_id, drug_concept_id, drug_era_start_date, date_diff('day', drug_era_start_date, drug_era_end_date) FROM drug_era WHERE date_diff('day', drug_era_start_date, drug_era_end_date) >= 7""",
)
def _(cdm):
    both = F.explode(F.array(*[
        F.struct(F.lit(i).alias("inclusive"), D.days_inclusive("drug_era_start_date", "drug_era_end_date", i).alias("days"))
        for i in (True, False)]))
    return cdm.drug_era.withColumn("_v", both).select("*", "_v.*").drop("_v").filter(F.col("days") >= 7)


@query(
    "washout_filter", "row_id:l days_from_obs_start:l",
    """SELECT row_id, date_diff('day', observation_period_start_date, cohort_start_date) AS days_from_obs_start
       FROM cohort_rows JOIN observation_period ON subject_id = person_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date
       WHERE date_diff('day', observation_period_start_date, cohort_start_date) >= 365""",
)
def _(cdm):
    rows = period_of(cdm.cohort_rows, cdm.observation_period, "cohort_start_date", "subject_id")
    return rows.withColumn("days_from_obs_start", D.days_between("op_start_date", "cohort_start_date")).filter(
        F.col("days_from_obs_start") >= 365)


@query(
    "study_date_filter", "row_id:l days_to_cohort_end:l",
    """SELECT row_id, date_diff('day', cohort_start_date, LEAST(cohort_end_date, DATE '1998-01-01')) AS days_to_cohort_end
       FROM cohort_all_rows WHERE cohort_start_date >= DATE '1996-01-01' AND cohort_start_date < DATE '1998-01-01'""",
)
def _(cdm):
    rows = with_row_id(cdm.cohort)
    lo, hi = F.lit("1996-01-01").cast("date"), F.lit("1998-01-01").cast("date")
    return rows.filter((F.col("cohort_start_date") >= lo) & (F.col("cohort_start_date") < hi)).select(
        "row_id", D.days_between("cohort_start_date", F.least("cohort_end_date", hi)).alias("days_to_cohort_end"))


@query(
    "include_exclude_concepts", "mode:s condition_concept_id:l records:l",
    """SELECT 'include' AS mode, condition_concept_id, count(*) AS records FROM condition_occurrence WHERE condition_concept_id IN (4000001, 4000002, 4000003) GROUP BY 2
      UNION ALL SELECT 'exclude', condition_concept_id, count(*) FROM condition_occurrence WHERE condition_concept_id NOT IN (4000001, 4000002, 4000003) GROUP BY 2""",
)
def _(cdm):
    ids = [4000001, 4000002, 4000003]

    def variant(mode, keep):
        return X.filter_concepts(cdm.condition_occurrence, "condition_concept_id", ids, keep).groupBy(
            "condition_concept_id").agg(F.count(F.lit(1)).alias("records")).withColumn("mode", F.lit(mode))

    return variant("include", True).unionByName(variant("exclude", False))


@query(
    "descendant_expand", "concept_id:l",
    f"""SELECT concept_id FROM (VALUES ({P.DRUGS['losartan']}), (5000002), (999)) AS v(concept_id)
      UNION SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({P.DRUGS['losartan']}, 5000002)""",
)
def _(cdm):
    return expand_descendants(cdm.concept_ancestor, [P.DRUGS["losartan"], 5000002, 999])


@query(
    "filter_by_row_id", "row_id:l covariate_id:l",
    """SELECT DISTINCT row_id, condition_concept_id * 1000 + 102 AS covariate_id FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id
      AND condition_start_date BETWEEN cohort_start_date - 365 AND cohort_start_date
      WHERE row_id IN (SELECT row_id FROM cohort_rows JOIN person ON subject_id = person_id WHERE year_of_birth < 1950)""",
)
def _(cdm):
    from vitalspan.catalog.common import condition_flags
    wanted = _cohort_person(cdm).filter(F.col("year_of_birth") < 1950).select("row_id")
    return subset_by_rows(condition_flags(cdm, -365, 0, 102), wanted)


@query(
    "filter_by_cohort_id", "cohort_definition_id:l covariate_id:l sum_value:l",
    """SELECT 2 AS cohort_definition_id, condition_concept_id * 1000 + 102 AS covariate_id, count(DISTINCT row_id) AS sum_value FROM cohort_rows
      JOIN condition_occurrence ON subject_id = person_id AND condition_start_date BETWEEN cohort_start_date - 365 AND cohort_start_date
      WHERE cohort_definition_id = 2 GROUP BY 2""",
)
def _(cdm):
    from vitalspan.catalog.common import condition_counts
    return subset_by_cohort(condition_counts(cdm, -365, 0, 102), [2])
