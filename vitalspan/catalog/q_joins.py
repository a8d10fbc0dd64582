"""Joins and aggregations of the safety-signal and cohort plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.q_cohorts import VIEWS as COHORT_VIEWS
from vitalspan.catalog.registry import query
from vitalspan.operators import ranges as R
from vitalspan.operators.eras import ingredient_exposures
from vitalspan.operators.summaries import discrete_percentiles, nonmissing_summary, sample_sd
from vitalspan.operators.vocab import source_code_map
from vitalspan.plans import cohorts as K
from vitalspan.plans import params as P
from vitalspan.plans import signal as G
from vitalspan.plans import study_cohorts as S
from vitalspan.plans.covariates import domain as D
from vitalspan.plans.covariates import scores as SC

_OP = "observation_period_start_date", "observation_period_end_date"


@query("ingredient_rollup", "person_id:l drug_concept_id:l start_date:d end_date:d", "SELECT person_id, ing AS drug_concept_id, sd AS start_date, ed AS end_date FROM resolved")
def _(cdm):
    return ingredient_exposures(cdm.drug_exposure, cdm.concept, cdm.concept_ancestor)


_CONTAINED = """SELECT c.person_id, condition_concept_id, condition_start_date, observation_period_start_date AS op_start_date, observation_period_end_date AS op_end_date FROM condition_occurrence c
  JOIN observation_period o ON o.person_id = c.person_id AND condition_start_date BETWEEN observation_period_start_date AND observation_period_end_date"""


@query("obs_period_containment", "person_id:l condition_concept_id:l condition_start_date:d op_start_date:d op_end_date:d", _CONTAINED)
def _(cdm):
    return R.period_of(cdm.condition_occurrence, cdm.observation_period, "condition_start_date")


@query("prior_days_required", "days:l person_id:l condition_start_date:d", " UNION ALL ".join(f"SELECT {n} AS days, person_id, condition_start_date FROM ({_CONTAINED}) WHERE op_start_date + {n} <= condition_start_date" for n in (30, 60)))
def _(cdm):
    rows = R.period_of(cdm.condition_occurrence, cdm.observation_period, "condition_start_date")
    gap = F.datediff("condition_start_date", "op_start_date")
    return rows.select("person_id", "condition_start_date", F.explode(F.filter(
        F.array(*[F.when(gap >= n, F.lit(n)) for n in (30, 60)]), lambda x: x.isNotNull())).alias("days"))


@query(
    "lookback_window_join", "row_id:l measurement_date:d measurement_concept_id:l n:l",
    """SELECT row_id, measurement_date, measurement_concept_id, count(*) AS n FROM cohort_rows JOIN observation_period o ON o.person_id = subject_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date
       JOIN measurement m ON m.person_id = subject_id AND measurement_date BETWEEN cohort_start_date - 60 AND cohort_start_date AND measurement_date BETWEEN observation_period_start_date AND observation_period_end_date GROUP BY 1, 2, 3""",
)
def _(cdm):
    rows = R.period_of(cdm.cohort_rows, cdm.observation_period, "cohort_start_date", "subject_id")
    rows = rows.select(
        "row_id", F.col("subject_id").alias("person_id"),
        F.greatest(F.date_sub("cohort_start_date", 60), "op_start_date").alias("_lo"),
        F.least("cohort_start_date", "op_end_date").alias("_hi"))
    daily = cdm.measurement.groupBy("person_id", "measurement_concept_id", "measurement_date").agg(F.count(F.lit(1)).alias("n"))
    return R.band_join(rows, daily, ["person_id"], "_lo", "_hi", "measurement_date", 60)


_R = "value_as_number / NULLIF({t}range_high, 0)"


@query(
    "nearby_event_join", "person_id:l start_date:d n:l",
    f"""SELECT b.person_id, b.d AS start_date, b.n FROM (SELECT person_id, measurement_date AS d, count(*) AS n FROM measurement WHERE measurement_concept_id = {P.BILIRUBIN} AND value_as_number / NULLIF(range_high, 0) > 2 GROUP BY 1, 2) b
      JOIN observation_period o ON o.person_id = b.person_id AND b.d BETWEEN observation_period_start_date AND observation_period_end_date
      WHERE EXISTS (SELECT 1 FROM measurement a WHERE a.person_id = b.person_id AND a.measurement_concept_id = {P.ALT} AND a.value_as_number / NULLIF(a.range_high, 0) > 1
        AND abs(date_diff('day', a.measurement_date, b.d)) <= 7 AND a.measurement_date BETWEEN observation_period_start_date AND observation_period_end_date)""",
)
def _(cdm):
    return K.nearby_days(cdm, K.LabTest((P.BILIRUBIN,), ratio=(">", 2.0)), K.LabTest((P.ALT,), ratio=(">", 1.0)), 7)


@query(
    "interval_overlap_join", "row_id:l other_start:d other_end:d",
    """SELECT a.row_id, b.cohort_start_date AS other_start, b.cohort_end_date AS other_end FROM cohort_rows a JOIN cohort b ON a.subject_id = b.subject_id AND b.cohort_definition_id = 4
       AND b.cohort_start_date <= a.cohort_start_date + 30 AND b.cohort_end_date >= a.cohort_start_date - 365""",
)
def _(cdm):
    rows = cdm.cohort_rows.select("row_id", "subject_id", F.date_sub("cohort_start_date", 365).alias("_lo"), F.date_add("cohort_start_date", 30).alias("_hi"))
    other = cdm.cohort.filter(F.col("cohort_definition_id") == 4).select(
        "subject_id", F.col("cohort_start_date").alias("other_start"), F.col("cohort_end_date").alias("other_end"))
    return R.overlap_join(rows, other, ["subject_id"], "_lo", "_hi", "other_start", "other_end", 396)


_TP = ((1, -365, -181), (2, -180, -31), (3, -30, 0), (4, -365, 0))


@query(
    "time_window_theta_join", "time_id:l row_id:l covariate_id:l",
    f"""SELECT DISTINCT time_id, row_id, measurement_concept_id * 1000 + 1 AS covariate_id FROM cohort_rows JOIN measurement ON person_id = subject_id
      JOIN (VALUES {', '.join(map(str, _TP))}) AS tp(time_id, a, b) ON measurement_date BETWEEN cohort_start_date + a AND cohort_start_date + b""",
)
def _(cdm):
    return D.temporal_flags(cdm, cdm.cohort_rows, D.DomainAnalysis("measurement", 1), _TP)


def _prefix(codes, c="condition_source_value", concepts=()):
    if concepts:
        return f"{c.replace('source_value', 'concept_id')} IN ({', '.join(map(str, concepts))})"
    return "(" + " OR ".join(f"upper({c}) LIKE '{p}%'" for p in codes) + ")"


_EXACT = "(date_diff('day', make_date(year_of_birth, month_of_birth, day_of_birth), drug_era_start_date) // 365)"


def _eras(spec, drugs: bool) -> str:
    age = f"{_EXACT} <= {spec.max_age}" if spec.max_age else f"{_EXACT} >= {spec.min_age}"
    names = " AND (" + " OR ".join(f"lower(concept_name) LIKE '%{n}%'" for n in spec.drug_names) + ")" if drugs else ""
    return f"""SELECT e.person_id, {_EXACT} AS age_onset, drug_concept_id, lower(concept_name) AS ingredient_name, drug_era_start_date AS sd, drug_era_end_date AS ed,
      date_diff('day', drug_era_start_date, drug_era_end_date) + 1 AS exposure_days FROM drug_era e JOIN person p ON p.person_id = e.person_id JOIN concept ON concept_id = drug_concept_id
      WHERE {age} AND date_diff('day', drug_era_start_date, drug_era_end_date) + 1 >= 7{names}"""


def _clean(spec, drugs: bool) -> str:
    return f"""SELECT * FROM ({_eras(spec, drugs)}) era WHERE NOT EXISTS (SELECT 1 FROM condition_occurrence past
      WHERE past.person_id = era.person_id AND past.condition_start_date + 60 < sd AND {_prefix(spec.prior_codes, 'past.condition_source_value', spec.prior_concepts)})"""


def _outcome(spec, drugs: bool) -> str:
    return f"""SELECT DISTINCT x.person_id, ingredient_name, sd, ed, condition_source_value, condition_start_date FROM ({_clean(spec, drugs)}) x
      JOIN condition_occurrence c ON c.person_id = x.person_id AND condition_start_date BETWEEN sd AND ed + 60 AND {_prefix(spec.outcome_codes, concepts=spec.outcome_concepts)}"""


def _case(spec):
    return f"SELECT condition_source_value, ingredient_name, count(DISTINCT person_id) AS case_count FROM ({_outcome(spec, True)}) GROUP BY 1, 2"


def _total(spec):
    return f"SELECT condition_source_value, count(DISTINCT person_id) AS total_count FROM ({_outcome(spec, False)}) GROUP BY 1"


def _report(spec, name):
    return f"SELECT '{name}' AS signal, a.ingredient_name, a.condition_source_value, case_count, total_count FROM ({_case(spec)}) a JOIN ({_total(spec)}) b ON a.condition_source_value = b.condition_source_value"


_ERA_OUT = "person_id:l age_onset:l ingredient_name:s sd:d ed:d exposure_days:l"


def _era_cols(df):
    return df.withColumnRenamed("drug_era_start_date", "sd").withColumnRenamed("drug_era_end_date", "ed")


@query("distinct_eras", _ERA_OUT, f"SELECT DISTINCT * FROM ({_eras(G.LIVER, True)})")
def _(cdm):
    cdm.pin("drug_era")
    return _era_cols(G.exposed_eras(cdm, G.LIVER).distinct())


@query("prior_condition_anti", _ERA_OUT, f"SELECT DISTINCT * FROM ({_clean(G.KIDNEY, True)})")
def _(cdm):
    cdm.pin("drug_era")
    return _era_cols(G.without_prior_disease(cdm, G.exposed_eras(cdm, G.KIDNEY), G.KIDNEY).distinct())


@query("concept_semi", "person_id:l drug_concept_id:l drug_era_start_date:d", "SELECT person_id, drug_concept_id, drug_era_start_date FROM drug_era WHERE drug_concept_id IN (SELECT concept_id FROM concept WHERE lower(concept_name) LIKE '%sartan%')")
def _(cdm):
    wanted = cdm.concept.filter(F.lower("concept_name").contains("sartan")).select(F.col("concept_id").alias("drug_concept_id"))
    return cdm.drug_era.join(wanted, "drug_concept_id", "left_semi")


_ABN = f"""SELECT c.row_id, count(m.person_id) AS n FROM cohort_rows c LEFT JOIN measurement m ON m.person_id = subject_id AND measurement_date BETWEEN cohort_start_date - 60 AND cohort_start_date
  AND measurement_concept_id IN ({', '.join(map(str, P.LIVER_LABS))}) AND value_as_number / NULLIF(range_high, 0) > 1 GROUP BY 1"""


def _abnormal(cdm):
    test = K.LabTest(P.LIVER_LABS, ratio=(">", 1.0)).matches()
    rows = cdm.cohort_rows.withColumnRenamed("subject_id", "person_id")
    return R.window_counts(rows, cdm.measurement, ["person_id"], "cohort_start_date", "measurement_date", -60, 0, {"n": test})


@query("zero_count_join", "row_id:l n:l", f"SELECT row_id, n FROM ({_ABN}) WHERE n <= 0")
def _(cdm):
    return _abnormal(cdm).filter(F.col("n") == 0)


@query("exactly_zero", "row_id:l", f"SELECT row_id FROM ({_ABN}) WHERE n = 0")
def _(cdm):
    records = cdm.measurement.filter(K.LabTest(P.LIVER_LABS, ratio=(">", 1.0)).matches())
    rows = cdm.cohort_rows.withColumnRenamed("subject_id", "person_id")
    return R.without_record(rows, records, ["person_id"], "cohort_start_date", "measurement_date", -60, 0)


@query("at_least_n", "k:l row_id:l n:l", " UNION ALL ".join(f"SELECT {k} AS k, row_id, n FROM ({_ABN}) WHERE n >= {k}" for k in (1, 2)))
def _(cdm):
    counted = _abnormal(cdm)
    return counted.select("row_id", "n", F.explode(F.filter(
        F.array(*[F.when(F.col("n") >= k, F.lit(k)) for k in (1, 2)]), lambda x: x.isNotNull())).alias("k"))


@query("outcome_window_join", "person_id:l ingredient_name:s sd:d condition_source_value:s condition_start_date:d", f"SELECT DISTINCT person_id, ingredient_name, sd, condition_source_value, condition_start_date FROM ({_outcome(G.LIVER, True)})")
def _(cdm):
    cdm.pin("drug_era")
    eras = _era_cols(G.without_prior_disease(cdm, G.exposed_eras(cdm, G.LIVER), G.LIVER)).select(
        "person_id", "ingredient_name", "sd", F.date_add("ed", 60).alias("_until")).distinct()
    found = cdm.condition_occurrence.filter(G.code_prefix_any("condition_source_value", G.LIVER.outcome_codes)).select(
        "person_id", "condition_source_value", "condition_start_date").distinct().withColumn("_day", F.col("condition_start_date"))
    return R.overlap_join(eras, found, ["person_id"], "sd", "_until", "condition_start_date", "_day", 92)


@query("first_era_self_join", "person_id:l drug_concept_id:l drug_era_start_date:d", "SELECT e.person_id, drug_concept_id, drug_era_start_date FROM drug_era e JOIN (SELECT person_id, min(drug_era_start_date) AS f FROM drug_era GROUP BY 1) m ON m.person_id = e.person_id AND drug_era_start_date = f")
def _(cdm):
    # All eras on the first day are kept, so the first day is a join key of a
    # one-row-per-person aggregate.
    first = cdm.drug_era.groupBy("person_id").agg(F.min("drug_era_start_date").alias("drug_era_start_date"))
    return cdm.drug_era.join(first, ["person_id", "drug_era_start_date"], "left_semi")


@query("case_count", "condition_source_value:s ingredient_name:s case_count:l", _case(G.LIVER))
def _(cdm):
    cdm.pin("drug_era")
    return G.case_counts(cdm, G.LIVER)


@query("total_case_count", "condition_source_value:s total_count:l", _total(G.LIVER))
def _(cdm):
    cdm.pin("drug_era")
    return G.total_case_counts(cdm, G.LIVER)


@query("case_total_join", "signal:s ingredient_name:s condition_source_value:s case_count:l total_count:l", _report(G.LIVER, "liver"))
def _(cdm):
    cdm.pin("drug_era")
    return G.case_counts(cdm, G.LIVER).join(G.total_case_counts(cdm, G.LIVER), "condition_source_value").withColumn("signal", F.lit("liver"))


@query("case_total_report", "signal:s ingredient_name:s condition_source_value:s case_count:l total_count:l", f"{_report(G.LIVER, 'liver')} UNION ALL {_report(G.KIDNEY, 'kidney')}")
def _(cdm):
    cdm.pin("drug_era")
    liver = G.case_total_report(cdm, G.LIVER).withColumn("signal", F.lit("liver"))
    return liver.unionByName(G.case_total_report(cdm, G.KIDNEY).withColumn("signal", F.lit("kidney")))


_BY_CONCEPT = G.SignalSpec(P.LIVER_SIGNAL_DRUGS, (), (), max_age=65, prior_concepts=(4000002, 4000007), outcome_concepts=(4000001, 4000011, 4000021))


@query("case_total_by_concept", "signal:s ingredient_name:s condition_source_value:s case_count:l total_count:l", _report(_BY_CONCEPT, "concepts"))
def _(cdm):
    cdm.pin("drug_era")
    return G.case_total_report(cdm, _BY_CONCEPT).withColumn("signal", F.lit("concepts"))


@query("ordered_report", "ingredient_name:s condition_source_value:s case_count:l total_count:l", f"SELECT ingredient_name, condition_source_value, case_count, total_count FROM ({_report(G.KIDNEY, 'k')}) ORDER BY 1, 2")
def _(cdm):
    cdm.pin("drug_era")
    return G.case_total_report(cdm, G.KIDNEY)


@query("name_lookup_scalar", "person_id:l drug_era_start_date:d ingredient_name:s", "SELECT person_id, drug_era_start_date, (SELECT concept_name FROM concept WHERE concept_id = drug_concept_id) AS ingredient_name FROM drug_era")
def _(cdm):
    names = cdm.concept.select(F.col("concept_id").alias("drug_concept_id"), F.col("concept_name").alias("ingredient_name"))
    return cdm.drug_era.join(names, "drug_concept_id", "left")


@query("totals_cross_join", "cohort_definition_id:l n:l total:l share:f", "SELECT cohort_definition_id, count(*) AS n, any_value(t) AS total, count(*) / any_value(t) AS share FROM cohort, (SELECT count(*) AS t FROM cohort) GROUP BY 1")
def _(cdm):
    # The one-row total is a scalar subquery, not a join side.
    total = cdm.cohort.agg(F.count(F.lit(1))).scalar()
    counts = cdm.cohort.groupBy("cohort_definition_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", total).withColumn("share", F.col("n") / F.col("total"))


@query(
    "triangular_self_join", "cohort_definition_id:l age:l total:l accumulated:l",
    """WITH prep AS (SELECT cohort_definition_id, year(cohort_start_date) - year_of_birth AS age, count(*) AS total FROM cohort_rows JOIN person ON person_id = subject_id GROUP BY 1, 2)
       SELECT s.cohort_definition_id, s.age, s.total, sum(p.total) AS accumulated FROM prep s JOIN prep p ON p.cohort_definition_id = s.cohort_definition_id AND p.age <= s.age GROUP BY 1, 2, 3""",
)
def _(cdm):
    from vitalspan.operators.ranks import running_totals
    ages = cdm.cohort_rows.join(cdm.person, F.col("subject_id") == F.col("person_id")).groupBy(
        "cohort_definition_id", (F.year("cohort_start_date") - F.col("year_of_birth")).alias("age")).agg(F.count(F.lit(1)).alias("total"))
    return running_totals(ages, ["cohort_definition_id"], "age", ["total"]).withColumnRenamed("cum_total", "accumulated")


@query(
    "inpatient_join", "person_id:l concept_id:l start_date:d",
    f"""SELECT DISTINCT c.person_id, condition_concept_id AS concept_id, condition_start_date AS start_date FROM condition_occurrence c JOIN visit_occurrence v ON v.person_id = c.person_id AND condition_start_date BETWEEN visit_start_date AND visit_end_date
      JOIN concept_ancestor ON descendant_concept_id = visit_concept_id AND ancestor_concept_id IN {P.INPATIENT_VISITS}""",
)
def _(cdm):
    return D.domain_records(cdm, D.DomainAnalysis("condition_occurrence", 1, inpatient=True))


@query("source_code_map", "source_code:s target_concept_id:l", "SELECT s.concept_code AS source_code, t.concept_id AS target_concept_id FROM concept_relationship JOIN concept s ON s.concept_id = concept_id_1 AND s.vocabulary_id = 'ICD10' JOIN concept t ON t.concept_id = concept_id_2 AND t.vocabulary_id = 'SNOMED' WHERE relationship_id = 'Maps to'")
def _(cdm):
    return source_code_map(cdm.concept, cdm.concept_relationship, "ICD10")


@query(
    "outcome_descendant_join", "row_id:l outcome_id:l days_to_event:l",
    """SELECT DISTINCT row_id, ancestor_concept_id AS outcome_id, date_diff('day', cohort_start_date, condition_era_start_date) AS days_to_event FROM cohort_rows JOIN observation_period o ON o.person_id = subject_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date
       JOIN condition_era e ON e.person_id = subject_id AND condition_era_start_date BETWEEN observation_period_start_date AND observation_period_end_date
       JOIN concept_ancestor ON descendant_concept_id = condition_concept_id AND ancestor_concept_id IN (5000001, 5000003)""",
)
def _(cdm):
    from vitalspan.plans.prediction.population import TargetSpec, era_outcomes, plp_cohort
    rows = plp_cohort(cdm, cdm.cohort_rows, TargetSpec(row_id="row_id"))
    return era_outcomes(cdm, rows, [5000001, 5000003])


@query(
    "attribute_join", "row_id:l covariate_id:l covariate_value:f",
    """SELECT a.row_id, 1 AS covariate_id, date_diff('day', observation_period_start_date, a.cohort_start_date) AS covariate_value FROM cohort_rows a JOIN observation_period ON person_id = a.subject_id
       AND a.cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date""",
)
def _(cdm):
    from vitalspan.plans.covariates import demographics as DG
    attributes = DG.observation_length_attribute(cdm, cdm.cohort_rows)
    return DG.attribute_covariates(cdm.cohort_rows, attributes, include=(1, 7))


@query("ref_name_join", "drug_concept_id:l label:s n:l", "SELECT drug_concept_id, COALESCE(concept_name, 'Unknown concept') AS label, count(*) AS n FROM drug_exposure LEFT JOIN concept ON concept_id = drug_concept_id GROUP BY 1, 2")
def _(cdm):
    counts = cdm.drug_exposure.groupBy("drug_concept_id").agg(F.count(F.lit(1)).alias("n"))
    names = cdm.concept.select(F.col("concept_id").alias("drug_concept_id"), "concept_name")
    return counts.join(names, "drug_concept_id", "left").withColumn("label", F.coalesce("concept_name", F.lit("Unknown concept")))


# --- aggregations --------------------------------------------------------------
@query("cohort_counts", "cohort_definition_id:l cohort_entries:l cohort_subjects:l database_id:s", "SELECT cohort_definition_id, count(*) AS cohort_entries, count(DISTINCT subject_id) AS cohort_subjects, 'db1' AS database_id FROM cohort WHERE cohort_definition_id IN (1, 3, 4) GROUP BY 1")
def _(cdm):
    return K.cohort_counts(cdm.cohort, [1, 3, 4], "db1")


@query(
    "named_counts", "cohort_definition_id:l cohort_name:s cohort_entries:l cohort_subjects:l",
    "SELECT c.c_nationkey AS cohort_definition_id, n_name AS cohort_name, count(o_orderkey) AS cohort_entries, count(DISTINCT o_custkey) AS cohort_subjects FROM orders JOIN customer c ON c_custkey = o_custkey JOIN nation ON n_nationkey = c.c_nationkey GROUP BY 1, 2",
)
def _(cdm):
    rows = cdm.orders.join(cdm.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("cohort_definition_id"), F.col("o_custkey").alias("subject_id"))
    names = cdm.nation.select(F.col("n_nationkey").alias("cohort_definition_id"), F.col("n_name").alias("cohort_name"), F.lit(0).alias("seq"))
    return K.named_counts(K.cohort_counts(rows), names.unionByName(names.withColumn("seq", F.lit(1)).withColumn("cohort_name", F.lit("later name"))))


@query("first_exposure_minmin", "cohort_definition_id:l subject_id:l cohort_start_date:d cohort_end_date:d", "SELECT cohort_definition_id, subject_id, min(cohort_start_date) AS cohort_start_date, min(cohort_end_date) AS cohort_end_date FROM cohort GROUP BY 1, 2")
def _(cdm):
    return S.first_exposure_minmin(cdm.cohort)


@query(
    "criteria_group", "mode:s cohort_definition_id:l person_id:l start_date:d",
    " UNION ALL ".join(f"SELECT '{m}' AS mode, cid AS cohort_definition_id, person_id, sd AS start_date FROM masked WHERE {w}" for m, w in (("all", "nlab = 4"), ("any", "nlab >= 1"), ("at_least", "nlab >= 3"))), COHORT_VIEWS,
)
def _(cdm):
    from vitalspan.catalog.q_cohorts import FAMILY
    each = tuple(K.Criterion(K.LabTest((c,))) for c in P.LIVER_LABS)
    rules = [K.LabRule(each, "all"), K.LabRule(each, "any"), K.LabRule(each, "at_least", 3)]
    flagged = K.rule_flags(cdm, K.qualified_events(cdm, FAMILY), rules)
    return flagged.select("cohort_definition_id", "person_id", "start_date", F.explode(F.filter(
        F.array(*[F.when(F.col(f"rule_{i}"), F.lit(r.mode)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())).alias("mode"))


_SPEC = ((1, "a", 1, (5000000, 5000001)), (2, "b", 2, (5000002,)), (3, "c", 6, (5000003,)))


@query(
    "category_weight_sum", "row_id:l covariate_value:f",
    f"""SELECT row_id, sum(w) AS covariate_value FROM (SELECT DISTINCT row_id, cat, w FROM cohort_rows JOIN condition_era ON person_id = subject_id AND condition_era_start_date <= cohort_start_date
      JOIN concept_ancestor ON descendant_concept_id = condition_concept_id JOIN (VALUES {', '.join(f'({r[0]}, {r[2]}, {a})' for r in _SPEC for a in r[3])}) AS v(cat, w, anc) ON anc = ancestor_concept_id) GROUP BY 1""",
)
def _(cdm):
    return SC.category_weight_sum(cdm, cdm.cohort_rows, _SPEC, 1)


@query(
    "category_max_sum", "row_id:l covariate_value:f",
    """SELECT row_id, sum(best) AS covariate_value FROM (SELECT row_id, condition_concept_id % 4 AS cat, max((condition_concept_id % 7) / 2.0) AS best FROM cohort_rows JOIN condition_era ON person_id = subject_id AND condition_era_start_date <= cohort_start_date GROUP BY 1, 2) GROUP BY 1""",
)
def _(cdm):
    scored = cdm.concept.filter((F.col("domain_id") == "Condition") & (F.col("concept_class_id") == "Clinical Finding")).select(
        "concept_id", (F.col("concept_id") % 4).alias("category"), ((F.col("concept_id") % 7) / 2.0).alias("score"))
    return SC.category_max_sum(cdm, cdm.cohort_rows, scored, 1)


_Q = (("median_value", .5), ("p10_value", .1), ("p25_value", .25), ("p75_value", .75), ("p90_value", .9))
_DIST = "count_value:l min_value:f max_value:f average_value:f standard_deviation:f " + " ".join(f"{n}:f" for n, _ in _Q)


@query(
    "continuous_summary", "nation:l " + _DIST,
    f"""WITH t AS (SELECT c_nationkey AS nation, c_custkey, count(o_orderkey) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY 1, 2)
      SELECT nation, sum((v > 0)::INT) AS count_value, min(v) AS min_value, max(v) AS max_value, avg(v) AS average_value, COALESCE(stddev_samp(CASE WHEN v > 0 THEN v END), 0) AS standard_deviation,
      {', '.join(f"CASE WHEN {q} * count(*) = sum((v = 0)::INT) THEN min(CASE WHEN v > 0 THEN v END) ELSE quantile_disc(v, {q}) END AS {n}" for n, q in _Q)} FROM t GROUP BY 1 HAVING sum((v > 0)::INT) > 0""",
)
def _(cdm):
    from vitalspan.operators.summaries import continuous_summary
    counts = cdm.orders.filter(F.col("o_totalprice") > 250000).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("value"))
    people = cdm.customer.select("c_custkey", F.col("c_nationkey").alias("nation"))
    values = counts.join(people, F.col("o_custkey") == F.col("c_custkey")).select("nation", "value")
    size = people.groupBy("nation").agg(F.count(F.lit(1)).alias("population_size"))
    return continuous_summary(values, size, ["nation"], ["nation"])


@query(
    "nonmissing_summary", "event_type:s " + _DIST,
    f"SELECT event_type, count(value) AS count_value, min(value) AS min_value, max(value) AS max_value, avg(value) AS average_value, stddev_samp(value) AS standard_deviation, {', '.join(f'quantile_disc(value, {q}) AS {n}' for n, q in _Q)} FROM events GROUP BY 1",
)
def _(cdm):
    return nonmissing_summary(cdm.events, ["event_type"], "value")


@query("discrete_percentile", "l_returnflag:s p10:f p50:f p99:f", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def _(cdm):
    return discrete_percentiles(cdm.lineitem, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


@query("sample_sd", "o_custkey:l sd:f n:l", "SELECT o_custkey, CASE WHEN count(*) = 1 THEN 0 ELSE sqrt((count(*) * sum(o_totalprice * o_totalprice) - sum(o_totalprice) * sum(o_totalprice)) / (count(*) * (count(*) - 1.0))) END AS sd, count(*) AS n FROM orders GROUP BY 1")
def _(cdm):
    return cdm.orders.groupBy("o_custkey").agg(sample_sd(F.col("o_totalprice")).alias("sd"), F.count(F.lit(1)).alias("n"))


@query(
    "pivot_margins", "event_type:s d1:f d2:f d3:f total:f",
    """SELECT CASE WHEN grouping(event_type) = 1 THEN '(all)' ELSE event_type END AS event_type, sum(CASE WHEN dayofweek(ts) IN (0, 6) THEN value END) AS d1, sum(CASE WHEN dayofweek(ts) IN (1, 2, 3) THEN value END) AS d2,
       sum(CASE WHEN dayofweek(ts) IN (4, 5) THEN value END) AS d3, sum(value) AS total FROM events GROUP BY CUBE (event_type)""",
)
def _(cdm):
    from vitalspan.operators.reshape import add_margins
    day = F.dayofweek("ts")  # 1 = Sunday
    part = F.when(day.isin(1, 7), "d1").when(day.isin(2, 3, 4), "d2").otherwise("d3")
    wide = add_margins(cdm.events.withColumn("part", part), "event_type", "part", ["d1", "d2", "d3"], "value")
    return wide.withColumnRenamed("(all)", "total")
