"""Covariate engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.registry import query
from vitalspan.plans import params as P
from vitalspan.plans.covariates import custom as C
from vitalspan.plans.covariates import demographics as G
from vitalspan.plans.covariates import domain as D
from vitalspan.plans.covariates import hdps as H
from vitalspan.plans.covariates import scores as S
from vitalspan.plans.covariates import tidy as T

COV = "row_id:l covariate_id:l covariate_value:f"
AGG = "cohort_definition_id:l covariate_id:l sum_value:l average_value:f"
DIST = ("count_value:l min_value:f max_value:f average_value:f standard_deviation:f median_value:f p10_value:f "
        "p25_value:f p75_value:f p90_value:f")

_WINDOW = "BETWEEN cohort_start_date - 365 AND cohort_start_date"


def _sizes() -> str:
    return "SELECT cohort_definition_id AS cd, count(*) AS size FROM cohort_rows GROUP BY 1"


def _share(rows: str, extra: str = "") -> str:
    """Aggregate distinct (cohort_definition_id, row_id, covariate_id)."""
    return f"""SELECT cohort_definition_id, covariate_id{extra}, count(*) AS sum_value, count(*) / any_value(size) AS average_value
      FROM ({rows}) r JOIN ({_sizes()}) z ON cd = cohort_definition_id GROUP BY cohort_definition_id, covariate_id{extra}"""


def _zero_filled(rows: str, keys: str = "cohort_definition_id, covariate_id") -> str:
    """Independent form: every cohort row gets a value or zero; discrete
    quantiles of that list, except where the zeros end exactly at the rank."""
    qs = ", ".join(
        f"CASE WHEN {q} * count(*) = count(*) - count(x) THEN min(x) ELSE quantile_disc(v, {q}) END AS {n}"
        for n, q in (("median_value", .5), ("p10_value", .1), ("p25_value", .25), ("p75_value", .75), ("p90_value", .9)))
    return f"""SELECT cohort_definition_id, covariate_id, count(x) AS count_value, min(v) AS min_value, max(v) AS max_value, avg(v) AS average_value,
      COALESCE(stddev_samp(x), 0) AS standard_deviation, {qs} FROM (SELECT c.cohort_definition_id, k.covariate_id, covariate_value AS x, COALESCE(covariate_value, 0) AS v FROM cohort_rows c
        JOIN (SELECT DISTINCT cohort_definition_id, covariate_id FROM ({rows})) k ON k.cohort_definition_id = c.cohort_definition_id
        LEFT JOIN ({rows}) r ON r.row_id = c.row_id AND r.covariate_id = k.covariate_id) GROUP BY {keys}"""


def _nonmissing(rows: str, keys: str = "cohort_definition_id, covariate_id") -> str:
    qs = ", ".join(
        f"min(CASE WHEN acc >= {q} * cnt THEN covariate_value END) AS {n}"
        for n, q in (("median_value", .5), ("p10_value", .1), ("p25_value", .25), ("p75_value", .75), ("p90_value", .9)))
    return f"""SELECT {keys}, count(*) AS count_value, min(covariate_value) AS min_value, max(covariate_value) AS max_value, avg(covariate_value) AS average_value,
      COALESCE(stddev_samp(covariate_value), 0) AS standard_deviation, {qs}
      FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS cnt, count(*) OVER (PARTITION BY {keys} ORDER BY covariate_value RANGE UNBOUNDED PRECEDING) AS acc FROM ({rows})) GROUP BY {keys}"""


# --- domain concepts ---------------------------------------------------------
CONDITIONS = D.DomainAnalysis("condition_occurrence", 102)
_INPATIENT_KINDS = f"SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({', '.join(map(str, P.INPATIENT_VISITS))})"
_COND_ROWS = f"""SELECT DISTINCT cohort_definition_id, row_id, condition_concept_id * 1000 + 102 AS covariate_id FROM cohort_rows
  JOIN condition_occurrence ON subject_id = person_id AND condition_start_date {_WINDOW}"""


@query(
    "cov_domain_concept", "kind:s row_id:l covariate_id:l covariate_value:f",
    f"""SELECT 'long' AS kind, row_id, covariate_id, 1 AS covariate_value FROM ({_COND_ROWS})
      UNION ALL SELECT DISTINCT 'any', row_id, drug_concept_id * 1000 + 401, 1 FROM cohort_rows JOIN drug_era ON subject_id = person_id AND drug_era_start_date <= cohort_start_date
      UNION ALL SELECT DISTINCT 'inpatient', row_id, condition_concept_id * 1000 + 103, 1 FROM cohort_rows c JOIN condition_occurrence o ON subject_id = o.person_id AND condition_start_date {_WINDOW}
        JOIN visit_occurrence v ON v.person_id = o.person_id AND condition_start_date BETWEEN visit_start_date AND visit_end_date AND visit_concept_id IN ({_INPATIENT_KINDS})
      UNION ALL SELECT DISTINCT 'era', row_id, drug_concept_id * 1000 + 402, 1 FROM cohort_rows JOIN drug_era ON subject_id = person_id AND drug_era_start_date <= cohort_start_date AND drug_era_end_date >= cohort_start_date - 180
        WHERE drug_concept_id NOT IN ({P.DRUGS['losartan']}, {P.DRUGS['valsartan']})""",
)
def _(cdm):
    parts = {
        "long": CONDITIONS,
        "any": D.DomainAnalysis("drug_era", 401, None),
        "inpatient": D.DomainAnalysis("condition_occurrence", 103, inpatient=True),
        "era": D.DomainAnalysis("drug_era", 402, -180, exclude=(P.DRUGS["losartan"], P.DRUGS["valsartan"])),
    }
    out = None
    for kind, a in parts.items():
        f = D.domain_flags(cdm, cdm.cohort_rows, a).withColumn("kind", F.lit(kind))
        out = f if out is None else out.unionByName(f)
    return out


@query("cov_domain_concept_agg", AGG, _share(_COND_ROWS))
def _(cdm):
    return D.aggregate_flags(D.domain_flags(cdm, cdm.cohort_rows, CONDITIONS), cdm.cohort_rows)


_DRUG_GROUPS = """SELECT descendant_concept_id, ancestor_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN (
    SELECT concept_id FROM concept WHERE vocabulary_id = 'ATC' AND length(concept_code) BETWEEN 1 AND 5 AND length(concept_code) <> 2
    UNION SELECT concept_id FROM concept WHERE domain_id = 'Drug' AND concept_class_id = 'Ingredient' AND standard_concept = 'S') GROUP BY ALL"""


@query(
    "cov_drug_group", COV,
    f"""SELECT DISTINCT row_id, ancestor_concept_id * 1000 + 410 AS covariate_id, 1 AS covariate_value FROM cohort_rows
      JOIN drug_era ON subject_id = person_id AND drug_era_start_date <= cohort_start_date AND drug_era_end_date >= cohort_start_date - 365
      JOIN ({_DRUG_GROUPS}) g ON descendant_concept_id = drug_concept_id""",
)
def _(cdm):
    return D.domain_flags(cdm, cdm.cohort_rows, D.DomainAnalysis("drug_era", 410, groups=True))


_LIKE = " OR ".join(f"concept_name LIKE '{p}'" for p in P.UNSPECIFIC_GROUP_NAMES)
_COND_GROUPS = f"""SELECT DISTINCT descendant_concept_id, ancestor_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN (
  SELECT concept_id FROM concept JOIN concept_ancestor ON concept_id = descendant_concept_id AND ancestor_concept_id = {P.CLINICAL_FINDING}
  WHERE (min_levels_of_separation > 2 OR descendant_concept_id IN ({', '.join(map(str, P.EXTRA_CONDITION_GROUPS))})) AND NOT ({_LIKE}) AND domain_id = 'Condition')"""


@query(
    "cov_condition_group", AGG,
    _share(f"""SELECT DISTINCT cohort_definition_id, row_id, ancestor_concept_id * 1000 + 210 AS covariate_id FROM cohort_rows
      JOIN condition_era ON subject_id = person_id AND condition_era_start_date <= cohort_start_date JOIN ({_COND_GROUPS}) g ON descendant_concept_id = condition_concept_id"""),
)
def _(cdm):
    flags = D.domain_flags(cdm, cdm.cohort_rows, D.DomainAnalysis("condition_era", 210, None, groups=True))
    return D.aggregate_flags(flags, cdm.cohort_rows)


_HITS = f"FROM cohort_rows JOIN drug_exposure ON subject_id = person_id AND drug_exposure_start_date {_WINDOW} AND drug_concept_id <> 0"
DRUGS_LONG = D.DomainAnalysis("drug_exposure", 902)


@query(
    "cov_concept_count", "kind:s row_id:l covariate_id:l covariate_value:f",
    f"""SELECT 'total' AS kind, row_id, 1902 AS covariate_id, count(*) AS covariate_value {_HITS} GROUP BY row_id
      UNION ALL SELECT 'distinct', row_id, 1902, count(DISTINCT drug_concept_id) {_HITS} GROUP BY row_id
      UNION ALL SELECT 'stratified', row_id, drug_concept_id * 1000 + 902, count(*) {_HITS} GROUP BY row_id, drug_concept_id""",
)
def _(cdm):
    out = None
    for kind in ("total", "distinct", "stratified"):
        f = D.concept_counts(cdm, cdm.cohort_rows, DRUGS_LONG, kind).withColumn("kind", F.lit(kind))
        out = f if out is None else out.unionByName(f)
    return out


_TOTALS = f"SELECT cohort_definition_id, row_id, 1902 AS covariate_id, count(*) AS covariate_value {_HITS} GROUP BY 1, 2"


@query("cov_concept_count_agg", f"cohort_definition_id:l covariate_id:l {DIST}", _zero_filled(_TOTALS))
def _(cdm):
    counts = D.concept_counts(cdm, cdm.cohort_rows, DRUGS_LONG)
    return D.aggregate_counts(counts, cdm.cohort_rows)


def _latest(analysis: int, condition: str, extra: str = "", part: str = "", windows: str = "") -> str:
    """Ordered aggregate: the pick per row and measurement (and window)."""
    order = "ORDER BY measurement_date DESC, unit_concept_id, value_as_number"
    return f"""SELECT cohort_definition_id, row_id{extra}, measurement_concept_id * 1000000 + (unit % 1000) * 1000 + {analysis} AS covariate_id, covariate_value FROM (
      SELECT cohort_definition_id, row_id{extra}, measurement_concept_id, first(unit_concept_id {order}) AS unit, first(value_as_number {order}) AS covariate_value
      FROM cohort_rows JOIN (SELECT * FROM measurement WHERE value_as_number IS NOT NULL) m ON subject_id = person_id {windows} WHERE {condition} GROUP BY cohort_definition_id, row_id, measurement_concept_id{part})"""


LABS_LONG = D.DomainAnalysis("measurement", 705)


@query(
    "cov_measurement_value", "kind:s row_id:l covariate_id:l covariate_value:f",
    f"""SELECT 'long' AS kind, row_id, covariate_id, covariate_value FROM ({_latest(705, 'measurement_date ' + _WINDOW)})
      UNION ALL SELECT 'any', row_id, covariate_id, covariate_value FROM ({_latest(706, 'measurement_date <= cohort_start_date')})""",
)
def _(cdm):
    found = D.measurement_values_of(cdm, cdm.cohort_rows, [LABS_LONG, D.DomainAnalysis("measurement", 706, None)])
    return found.withColumn("kind", F.when(F.col("analysis_id") == 706, "any").otherwise("long"))


@query(
    "cov_measurement_value_agg", f"cohort_definition_id:l covariate_id:l {DIST}",
    _nonmissing(_latest(705, "measurement_date " + _WINDOW)),
)
def _(cdm):
    return D.aggregate_measurements(D.measurement_values(cdm, cdm.cohort_rows, LABS_LONG))


@query(
    "cov_measurement_range", AGG,
    _share(f"""SELECT DISTINCT cohort_definition_id, row_id, measurement_concept_id * 10000 + CASE WHEN value_as_number < range_low THEN 1 WHEN value_as_number > range_high THEN 3 ELSE 2 END * 1000 + 709 AS covariate_id
      FROM cohort_rows JOIN measurement ON subject_id = person_id AND measurement_date {_WINDOW} WHERE range_low IS NOT NULL AND range_high IS NOT NULL"""),
)
def _(cdm):
    ranges = D.measurement_ranges(cdm, cdm.cohort_rows, D.DomainAnalysis("measurement", 709))
    return D.aggregate_flags(ranges, cdm.cohort_rows)


# --- demographics --------------------------------------------------------------
_PERSON = "FROM cohort_rows JOIN person ON subject_id = person_id"


def _simple(name, fn, sql):
    @query(name, COV, sql)
    def _(cdm, fn=fn):
        return fn(cdm, cdm.cohort_rows)


_simple("cov_gender", G.gender, f"SELECT row_id, gender_concept_id * 1000 + 1 AS covariate_id, 1 AS covariate_value {_PERSON} WHERE gender_concept_id <> 0")
_simple("cov_race", G.race, f"SELECT row_id, race_concept_id * 1000 + 4 AS covariate_id, 1 AS covariate_value {_PERSON} WHERE race_concept_id <> 0")
_simple("cov_ethnicity", G.ethnicity, f"SELECT row_id, ethnicity_concept_id * 1000 + 5 AS covariate_id, 1 AS covariate_value {_PERSON} WHERE ethnicity_concept_id <> 0")
_simple("cov_age_group", G.age_group, f"SELECT row_id, ((year(cohort_start_date) - year_of_birth) // 5) * 1000 + 3 AS covariate_id, 1 AS covariate_value {_PERSON}")
_simple("cov_index_year", G.index_year, "SELECT row_id, year(cohort_start_date) * 1000 + 6 AS covariate_id, 1 AS covariate_value FROM cohort_rows")
_simple("cov_index_month", G.index_month, "SELECT row_id, month(cohort_start_date) * 1000 + 7 AS covariate_id, 1 AS covariate_value FROM cohort_rows")
_simple("cov_index_year_month", G.index_year_month, "SELECT row_id, year(cohort_start_date) * 100000 + month(cohort_start_date) * 1000 + 12 AS covariate_id, 1 AS covariate_value FROM cohort_rows")
_OP = "FROM cohort_rows JOIN observation_period ON subject_id = person_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date"
_simple("cov_time_prior_obs", G.time_prior, f"SELECT row_id, 1008 AS covariate_id, date_diff('day', observation_period_start_date, cohort_start_date) AS covariate_value {_OP}")
_simple("cov_time_post_obs", G.time_post, f"SELECT row_id, 1009 AS covariate_id, date_diff('day', cohort_start_date, observation_period_end_date) AS covariate_value {_OP}")


_IN_COHORT = "SELECT cohort_definition_id, row_id, 1010 AS covariate_id, date_diff('day', cohort_start_date, cohort_end_date) AS covariate_value FROM cohort_rows"


@query("cov_time_in_cohort", f"cohort_definition_id:l covariate_id:l {DIST}", _zero_filled(_IN_COHORT))
def _(cdm):
    return D.aggregate_counts(G.time_in_cohort(cdm, cdm.cohort_rows), cdm.cohort_rows)


@query(
    "cov_age", f"cohort_definition_id:l covariate_id:l {DIST}",
    _zero_filled(f"SELECT cohort_definition_id, row_id, 1002 AS covariate_id, year(cohort_start_date) - year_of_birth AS covariate_value {_PERSON}"),
)
def _(cdm):
    return D.aggregate_counts(G.age(cdm, cdm.cohort_rows), cdm.cohort_rows)


# --- scores ----------------------------------------------------------------------
def _spec_rows(spec, i):
    return ", ".join(f"({r[0]}, {float(r[2])}, {a})" for r in spec for a in r[i])


def _score_sql(spec, analysis, extra=""):
    return f"""SELECT row_id, {1000 + analysis} AS covariate_id, sum(weight) AS covariate_value FROM (
      SELECT DISTINCT row_id, category, weight FROM cohort_rows JOIN condition_era ON subject_id = person_id AND condition_era_start_date <= cohort_start_date
      JOIN (SELECT category, weight, descendant_concept_id AS concept FROM (VALUES {_spec_rows(spec, 3)}) AS v(category, weight, anc) JOIN concept_ancestor ON ancestor_concept_id = anc) s ON concept = condition_concept_id
      {extra}) GROUP BY row_id"""


_simple("cov_charlson", S.charlson, _score_sql(P.CHARLSON, 901))
_simple("cov_chads2", S.chads2, _score_sql(
    P.CHADS2, 903, f"UNION SELECT row_id, 3, CASE WHEN year(cohort_start_date) - year_of_birth >= 75 THEN 1 ELSE 0 END {_PERSON}"))


def _vasc_sql():
    gone = ", ".join(f"({r[0]}, {a})" for r in P.CHADS2VASC for a in r[4])
    extra = ", ".join(f"({r[0]}, {float(r[2])}, {c})" for r in P.CHADS2VASC for c in r[5])
    return f"""SELECT row_id, 1904 AS covariate_id, sum(weight) AS covariate_value FROM (
      SELECT DISTINCT row_id, category, weight FROM cohort_rows JOIN condition_era ON subject_id = person_id AND condition_era_start_date <= cohort_start_date
      JOIN (SELECT category, weight, descendant_concept_id AS concept FROM (VALUES {_spec_rows(P.CHADS2VASC, 3)}) AS v(category, weight, anc) JOIN concept_ancestor ON ancestor_concept_id = anc
          WHERE NOT EXISTS (SELECT 1 FROM (VALUES {gone}) AS g(c2, a2) JOIN concept_ancestor x ON x.ancestor_concept_id = a2 WHERE c2 = category AND x.descendant_concept_id = concept_ancestor.descendant_concept_id)
        UNION SELECT c3, w3, i3 FROM (VALUES {extra}) AS e(c3, w3, i3) JOIN concept ON concept_id = i3 AND invalid_reason IS NULL) s ON concept = condition_concept_id
      UNION SELECT row_id, 3, CASE WHEN year(cohort_start_date) - year_of_birth >= 75 THEN 2 WHEN year(cohort_start_date) - year_of_birth >= 65 THEN 1 ELSE 0 END
        + CASE WHEN gender_concept_id = {P.FEMALE} THEN 1 ELSE 0 END {_PERSON}) GROUP BY row_id"""


_simple("cov_chads2vasc", S.chads2vasc, _vasc_sql())
_MAP = """(SELECT s.concept_code AS code, t.concept_id AS target FROM concept_relationship JOIN concept s ON s.concept_id = concept_id_1 JOIN concept t ON t.concept_id = concept_id_2
  WHERE s.vocabulary_id = '{v}' AND t.vocabulary_id = 'SNOMED' AND relationship_id = 'Maps to')"""


def _dcsi_sql():
    def test(prefixes, exact, between):
        parts = [f"code LIKE '{p}%'" for p in prefixes] + [f"code = '{e}'" for e in exact]
        if between:
            parts.append(f"code BETWEEN '{between[0]}' AND '{between[1]}'")
        return "(" + " OR ".join(parts) + ")"

    m = _MAP.format(v="ICD9CM")
    scored = " UNION ALL ".join(
        f"SELECT '{c}' AS category, {s} AS score, target FROM {m} WHERE {test(p, e, b)}" for c, s, p, e, b in P.DCSI)
    return f"""SELECT row_id, 1902 AS covariate_id, sum(best) AS covariate_value FROM (SELECT row_id, category, max(score) AS best FROM cohort_rows
      JOIN condition_era ON subject_id = person_id AND condition_era_start_date <= cohort_start_date JOIN ({scored}) s ON target = condition_concept_id GROUP BY 1, 2) GROUP BY row_id"""


_simple("cov_dcsi", S.dcsi, _dcsi_sql())
_HF = ", ".join(f"('{c}', {s})" for c, s in P.HFRS)
_simple("cov_hfrs", S.hfrs, f"""SELECT row_id, 1926 AS covariate_id, sum(best) AS covariate_value FROM (SELECT row_id, prefix, max(score) AS best FROM cohort_rows
  JOIN condition_era ON subject_id = person_id AND condition_era_start_date <= cohort_start_date
  JOIN (SELECT prefix, score, target FROM (VALUES {_HF}) AS h(prefix, score) JOIN {_MAP.format(v='ICD10')} m ON code LIKE prefix || '%') s ON target = condition_concept_id GROUP BY 1, 2) GROUP BY row_id""")

# --- propensity features -----------------------------------------------------------
_W180 = "BETWEEN cohort_start_date - 180 AND cohort_start_date"
_ICD9 = f"""(SELECT target AS cid, CASE WHEN c3 LIKE 'E%' THEN 1000 + CAST(substr(c3, 2, 2) AS INTEGER) WHEN c3 LIKE 'V%' THEN 1100 + CAST(substr(c3, 2, 2) AS INTEGER) ELSE CAST(c3 AS INTEGER) END AS code
  FROM (SELECT target, min(substr(code, 1, 3)) AS c3 FROM {_MAP.format(v='ICD9CM')} GROUP BY 1))"""
_INGR = "(SELECT descendant_concept_id AS cid, ancestor_concept_id AS code FROM concept_ancestor JOIN concept ON ancestor_concept_id = concept_id WHERE vocabulary_id = 'RxNorm' AND concept_class_id = 'Ingredient')"


def _freq_sql(source):
    visit = "JOIN visit_occurrence v ON v.visit_occurrence_id = r.visit_occurrence_id AND v.visit_concept_id " + ("= 9201" if source.endswith("inpatient") else "<> 9201")
    if source.startswith("icd9"):
        return f"SELECT row_id, code, count(*) AS frequency FROM cohort_rows JOIN condition_occurrence r ON subject_id = r.person_id AND condition_start_date {_W180} {visit} JOIN {_ICD9} i ON cid = condition_concept_id GROUP BY 1, 2"
    if source == "ingredient":
        return f"SELECT row_id, code, count(*) AS frequency FROM cohort_rows JOIN drug_exposure r ON subject_id = r.person_id AND drug_exposure_start_date {_W180} AND drug_concept_id <> 0 JOIN {_INGR} i ON cid = drug_concept_id GROUP BY 1, 2"
    return f"SELECT row_id, procedure_concept_id AS code, count(*) AS frequency FROM cohort_rows JOIN procedure_occurrence r ON subject_id = r.person_id AND procedure_date {_W180} {visit} GROUP BY 1, 2"


def _threshold_sql(freq):
    return f"""SELECT code, COALESCE(max(frequency) FILTER (WHERE place <= 0.50 * size), -9999) AS median_value, COALESCE(max(frequency) FILTER (WHERE place <= 0.75 * size), -9999) AS q75_value
      FROM (SELECT *, rank() OVER w AS place, count(*) OVER (PARTITION BY code) AS size FROM ({freq}) WINDOW w AS (PARTITION BY code ORDER BY frequency)) GROUP BY code"""


def _flags_sql(source):
    a, m, u = H.ANALYSES[source]
    f = _freq_sql(source)
    return f"""SELECT row_id, f.code * 1000 + analysis AS covariate_id, 1 AS covariate_value FROM ({f}) f JOIN ({_threshold_sql(f)}) t ON t.code = f.code,
      (VALUES ({a}), ({m}), ({u})) AS w(analysis) WHERE analysis = {a} OR (analysis = {m} AND frequency >= median_value AND median_value > 1) OR (analysis = {u} AND frequency >= q75_value AND q75_value > median_value)"""


@query("cov_hdps", COV, " UNION ".join(_flags_sql(s) for s in H.ANALYSES))
def _(cdm):
    return H.hdps_covariates(cdm, cdm.cohort_rows)


@query("hdps_frequency", "row_id:l code:l frequency:l", _freq_sql("ingredient"))
def _(cdm):
    return H.frequencies(cdm, cdm.cohort_rows, ("ingredient",))


@query("hdps_thresholds", "code:l median_value:l q75_value:l", _threshold_sql(_freq_sql("ingredient")))
def _(cdm):
    return H.thresholds(H.frequencies(cdm, cdm.cohort_rows, ("ingredient",)))


@query(
    "small_count_drop", COV,
    f"""WITH c AS ({_flags_sql('ingredient')}) SELECT * FROM c WHERE covariate_id IN (SELECT covariate_id FROM c GROUP BY 1 HAVING count(row_id) > 25)""",
)
def _(cdm):
    return H.drop_small_counts(H.hdps_covariates(cdm, cdm.cohort_rows, ("ingredient",)), 25)


@query(
    "icd9_numeric_code", "code:s number:l",
    """SELECT concept_code AS code, CASE WHEN concept_code LIKE 'E%' THEN 1000 + CAST(substr(concept_code, 2, 2) AS INTEGER) WHEN concept_code LIKE 'V%' THEN 1100 + CAST(substr(concept_code, 2, 2) AS INTEGER)
       ELSE CAST(substr(concept_code, 1, 3) AS INTEGER) END AS number FROM concept WHERE vocabulary_id = 'ICD9CM'""",
)
def _(cdm):
    from vitalspan.operators.vocab import icd9_number
    return cdm.concept.filter(F.col("vocabulary_id") == "ICD9CM").select(
        F.col("concept_code").alias("code"), icd9_number(F.col("concept_code")).alias("number"))


# --- temporal ------------------------------------------------------------------------
WEEKS = tuple((i + 1, -7 * (i + 1), -7 * i - 1) for i in range(20))


@query(
    "cov_temporal", "kind:s time_id:l row_id:l covariate_id:l covariate_value:f",
    f"""WITH tp AS (SELECT * FROM (VALUES {', '.join(map(str, WEEKS))}) AS v(time_id, a, b))
      SELECT DISTINCT 'point' AS kind, time_id, row_id, condition_concept_id * 1000 + 102 AS covariate_id, 1 AS covariate_value FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id
        JOIN tp ON condition_start_date BETWEEN cohort_start_date + a AND cohort_start_date + b
      UNION ALL SELECT DISTINCT 'era', time_id, row_id, drug_concept_id * 1000 + 402, 1 FROM cohort_rows JOIN drug_era ON subject_id = person_id
        JOIN tp ON drug_era_start_date <= cohort_start_date + b AND drug_era_end_date >= cohort_start_date + a""",
)
def _(cdm):
    a = D.temporal_flags(cdm, cdm.cohort_rows, CONDITIONS, WEEKS).withColumn("kind", F.lit("point"))
    b = D.temporal_flags(cdm, cdm.cohort_rows, D.DomainAnalysis("drug_era", 402), WEEKS).withColumn("kind", F.lit("era"))
    return a.unionByName(b)


@query(
    "cov_temporal_sequence", "part:s time_id:l row_id:l covariate_id:l",
    f"""SELECT DISTINCT 'day' AS part, CAST(floor(date_diff('day', condition_start_date, cohort_start_date) / 30.0) AS BIGINT) AS time_id, row_id, condition_concept_id * 1000 + 102 AS covariate_id
        FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id AND condition_start_date {_WINDOW}
      UNION ALL SELECT DISTINCT 'month', date_diff('month', condition_start_date, cohort_start_date), row_id, condition_concept_id * 1000 + 102
        FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id AND condition_start_date {_WINDOW}""",
)
def _(cdm):
    day = D.sequence_flags(cdm, cdm.cohort_rows, CONDITIONS, "day", 30).withColumn("part", F.lit("day"))
    month = D.sequence_flags(cdm, cdm.cohort_rows, CONDITIONS, "month", 1).withColumn("part", F.lit("month"))
    return day.unionByName(month)


_SPANS = ((1, -90, -31), (2, -30, 0), (3, -365, 0))
_TEMPORAL_LABS = _latest(
    705, "measurement_date BETWEEN cohort_start_date + a AND cohort_start_date + b", ", time_id", ", time_id",
    f", (VALUES {', '.join(map(str, _SPANS))}) AS tp(time_id, a, b)")


@query("cov_temporal_measurement", "time_id:l row_id:l covariate_id:l covariate_value:f", _TEMPORAL_LABS)
def _(cdm):
    return D.measurement_values(cdm, cdm.cohort_rows, LABS_LONG, _SPANS)


@query(
    "cov_temporal_measurement_agg", f"cohort_definition_id:l time_id:l covariate_id:l {DIST}",
    _nonmissing(_TEMPORAL_LABS, "cohort_definition_id, time_id, covariate_id"),
)
def _(cdm):
    return D.aggregate_measurements(D.measurement_values(cdm, cdm.cohort_rows, LABS_LONG, _SPANS), ["time_id"])


@query("cov_cohort_attr", COV, f"SELECT row_id, 1 AS covariate_id, date_diff('day', observation_period_start_date, cohort_start_date) AS covariate_value {_OP}")
def _(cdm):
    return G.attribute_covariates(cdm.cohort_rows, G.observation_length_attribute(cdm, cdm.cohort_rows), include=[1])


@query(
    "loo_attribute", "cohort_definition_id:l subject_id:l cohort_start_date:d attribute_definition_id:l value_as_number:f",
    f"SELECT cohort_definition_id, subject_id, cohort_start_date, 1 AS attribute_definition_id, date_diff('day', observation_period_start_date, cohort_start_date) AS value_as_number {_OP}",
)
def _(cdm):
    return G.observation_length_attribute(cdm, cdm.cohort_rows)


@query(
    "cov_ref", "covariate_id:l covariate_name:s analysis_id:l concept_id:l",
    f"""SELECT covariate_id, 'condition_occurrence during day -365 through 0 days relative to index: ' || COALESCE(concept_name, 'Unknown concept') AS covariate_name, 102 AS analysis_id, cid AS concept_id
      FROM (SELECT DISTINCT covariate_id, (covariate_id - 102) // 1000 AS cid FROM ({_COND_ROWS})) LEFT JOIN concept ON concept_id = cid""",
)
def _(cdm):
    return D.covariate_reference(D.domain_flags(cdm, cdm.cohort_rows, CONDITIONS), cdm.concept, CONDITIONS)


@query(
    "analysis_ref", "analysis_id:l analysis_name:s domain_id:s start_day:l end_day:l is_binary:s missing_means_zero:s covariates:l",
    f"""SELECT 102 AS analysis_id, 'ConditionOccurrenceLongTerm' AS analysis_name, 'Condition' AS domain_id, -365 AS start_day, 0 AS end_day, 'Y' AS is_binary, CAST(NULL AS VARCHAR) AS missing_means_zero,
        (SELECT count(DISTINCT covariate_id) FROM ({_COND_ROWS})) AS covariates
      UNION ALL SELECT 705, 'MeasurementValueLongTerm', 'Measurement', -365, 0, 'N', 'N', (SELECT count(DISTINCT covariate_id) FROM ({_latest(705, 'measurement_date ' + _WINDOW)}))""",
)
def _(cdm):
    refs = D.analysis_reference(cdm.spark, [
        (102, "ConditionOccurrenceLongTerm", "Condition", -365, 0, "Y", None),
        (705, "MeasurementValueLongTerm", "Measurement", -365, 0, "N", "N")])
    both = D.domain_flags(cdm, cdm.cohort_rows, CONDITIONS).unionByName(
        D.measurement_values(cdm, cdm.cohort_rows, LABS_LONG))
    counts = both.groupBy((F.col("covariate_id") % 1000).alias("analysis_id")).agg(
        F.countDistinct("covariate_id").alias("covariates"))
    return refs.join(counts, "analysis_id")


_PRESET = " UNION ALL ".join(
    f"SELECT cohort_definition_id, covariate_id, count(*) AS sum_value FROM (SELECT DISTINCT cohort_definition_id, row_id, condition_concept_id * 1000 + {a} AS covariate_id FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id AND condition_start_date <= cohort_start_date{w}) GROUP BY 1, 2"
    for a, w in ((101, ""), (102, " AND condition_start_date >= cohort_start_date - 365"),
                 (103, " AND condition_start_date >= cohort_start_date - 180"), (104, " AND condition_start_date >= cohort_start_date - 30")))


@query("cov_presets", "cohort_definition_id:l covariate_id:l sum_value:l", _PRESET)
def _(cdm):
    from vitalspan.plans.covariates.settings import CovariateSettings, extract
    settings = CovariateSettings(domains={"condition_occurrence": ("any_time", "long", "medium", "short")})
    return D.aggregate_flags(extract(cdm, cdm.cohort_rows, settings).covariates, cdm.cohort_rows)


@query(
    "cov_exclude_descendants", "covariate_id:l rows:l",
    f"""SELECT drug_concept_id * 1000 + 301 AS covariate_id, count(DISTINCT row_id) AS rows FROM cohort_rows JOIN drug_exposure ON subject_id = person_id AND drug_exposure_start_date {_WINDOW} AND drug_concept_id <> 0
      WHERE drug_concept_id NOT IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = {P.DRUGS['diclofenac']}) GROUP BY 1""",
)
def _(cdm):
    a = D.exclude_with_descendants(cdm, D.DomainAnalysis("drug_exposure", 301), [P.DRUGS["diclofenac"]])
    return D.domain_flags(cdm, cdm.cohort_rows, a).groupBy("covariate_id").agg(F.countDistinct("row_id").alias("rows"))


_AGES = f"SELECT cohort_definition_id, row_id, 1002 AS covariate_id, year(cohort_start_date) - year_of_birth AS covariate_value {_PERSON}"


@query(
    "aggregate_covariates", f"cohort_definition_id:l covariate_id:l kind:s {DIST}",
    f"""SELECT *, 'zero' AS kind FROM ({_zero_filled(_AGES + ' UNION ALL ' + _TOTALS)})
      UNION ALL SELECT *, 'missing' FROM ({_nonmissing(_latest(705, 'measurement_date ' + _WINDOW))})
      UNION ALL SELECT cohort_definition_id, covariate_id, sum_value, NULL, NULL, average_value, NULL, NULL, NULL, NULL, NULL, NULL, 'binary' FROM ({_share(_COND_ROWS)})""",
)
def _(cdm):
    from vitalspan.plans.covariates.settings import aggregate
    c = cdm.cohort_rows
    both = G.age(cdm, c).unionByName(D.concept_counts(cdm, c, DRUGS_LONG).select(*G.age(cdm, c).columns))
    labs = D.measurement_values(cdm, c, LABS_LONG).select(*both.columns)
    flags = D.domain_flags(cdm, c, CONDITIONS).select(*both.columns)
    refs = D.analysis_reference(cdm.spark, [
        (2, "Age", "Demographics", None, None, "N", "Y"), (902, "Counts", "Drug", -365, 0, "N", "Y"),
        (705, "Labs", "Measurement", -365, 0, "N", "N"), (102, "Conditions", "Condition", -365, 0, "Y", None)])
    return aggregate(both.unionByName(labs).unionByName(flags), refs, c)


# --- tidy, table one, differences ---------------------------------------------------
_ALL = f"""SELECT row_id, gender_concept_id * 1000 + 1 AS covariate_id, 1.0 AS covariate_value {_PERSON}
  UNION ALL SELECT row_id, ((year(cohort_start_date) - year_of_birth) // 5) * 1000 + 3, 1 {_PERSON}
  UNION ALL SELECT row_id, 1002, year(cohort_start_date) - year_of_birth {_PERSON}
  UNION ALL SELECT DISTINCT row_id, condition_concept_id * 1000 + 102, 1 FROM cohort_rows JOIN condition_occurrence ON subject_id = person_id AND condition_start_date {_WINDOW}
  UNION ALL SELECT row_id, covariate_id, covariate_value FROM ({_latest(705, 'measurement_date ' + _WINDOW)})"""


def _mixed(cdm):
    c = cdm.cohort_rows
    out = None
    for f in (G.gender(cdm, c), G.age_group(cdm, c), G.age(cdm, c), D.domain_flags(cdm, c, CONDITIONS),
              D.measurement_values(cdm, c, LABS_LONG)):
        f = f.select("cohort_definition_id", "row_id", "covariate_id", "covariate_value")
        out = f if out is None else out.unionByName(f)
    return out


@query(
    "tidy_covariates", COV,
    f"""WITH al AS ({_ALL}), n AS (SELECT count(*) AS size FROM cohort_rows),
      st AS (SELECT covariate_id, covariate_id % 1000 AS aid, count(*) AS cnt, max(covariate_value) AS mx, count(DISTINCT covariate_value) AS dv FROM al GROUP BY 1),
      cover AS (SELECT aid, sum(cnt) AS total FROM st WHERE mx = 1 AND dv = 1 GROUP BY 1),
      red AS (SELECT covariate_id, aid FROM st, n WHERE dv = 1 AND cnt = size
        UNION SELECT covariate_id, aid FROM (SELECT st.covariate_id, st.aid, row_number() OVER (PARTITION BY st.aid ORDER BY cnt DESC, st.covariate_id) AS rn
          FROM st JOIN cover ON cover.aid = st.aid, n WHERE st.aid IN (1, 3) AND total = size AND mx = 1 AND dv = 1) WHERE rn = 1),
      rare AS (SELECT covariate_id FROM st, n WHERE cnt / size < 0.05 AND aid NOT IN (SELECT aid FROM red))
      SELECT row_id, al.covariate_id, covariate_value / mx AS covariate_value FROM al JOIN st ON st.covariate_id = al.covariate_id
      WHERE al.covariate_id NOT IN (SELECT covariate_id FROM red) AND al.covariate_id NOT IN (SELECT covariate_id FROM rare)""",
)
def _(cdm):
    tidied, _state = T.tidy(_mixed(cdm), cdm.cohort_rows, min_fraction=0.05)
    return tidied


_T1 = (("Age group", 3), ("Gender", 1), ("Condition", 102))


@query(
    "table1", "section:s covariate_id:l pct_1:f pct_2:f",
    " UNION ALL ".join(f"""SELECT '{s}' AS section, covariate_id, 100.0 * sum(CASE WHEN cohort_definition_id = 1 THEN average_value END) AS pct_1, 100.0 * sum(CASE WHEN cohort_definition_id = 2 THEN average_value END) AS pct_2
      FROM ({_share(rows)}) GROUP BY covariate_id""" for (s, _), rows in zip(_T1, (
        f"SELECT cohort_definition_id, row_id, ((year(cohort_start_date) - year_of_birth) // 5) * 1000 + 3 AS covariate_id {_PERSON}",
        f"SELECT cohort_definition_id, row_id, gender_concept_id * 1000 + 1 AS covariate_id {_PERSON}", _COND_ROWS), strict=True)),
)
def _(cdm):
    agg = D.aggregate_flags(_mixed(cdm).filter(F.pmod("covariate_id", F.lit(1000)).isin(1, 3, 102)), cdm.cohort_rows)
    return T.table1(agg, _T1, [1, 2])


_BIN = f"""SELECT covariate_id, COALESCE(sum(CASE WHEN cohort_definition_id = 1 THEN average_value END), 0) AS m1, COALESCE(sum(CASE WHEN cohort_definition_id = 2 THEN average_value END), 0) AS m2
  FROM ({_share(_COND_ROWS)}) GROUP BY 1"""


@query(
    "std_diff", "covariate_id:l mean_1:f mean_2:f std_diff:f",
    f"SELECT covariate_id, m1 AS mean_1, m2 AS mean_2, (m1 - m2) / NULLIF(sqrt((m1 * (1 - m1) + m2 * (1 - m2)) / 2), 0) AS std_diff FROM ({_BIN})",
)
def _(cdm):
    agg = D.aggregate_flags(D.domain_flags(cdm, cdm.cohort_rows, CONDITIONS), cdm.cohort_rows)
    return T.binary_differences(agg, 1, 2)


_LAB_DIST = _nonmissing(_latest(705, "measurement_date " + _WINDOW))


@query(
    "std_diff_continuous", "covariate_id:l mean_1:f mean_2:f std_diff:f",
    f"""SELECT a.covariate_id, a.average_value AS mean_1, b.average_value AS mean_2,
      (a.average_value - b.average_value) / NULLIF(sqrt((power(a.standard_deviation, 2) + power(b.standard_deviation, 2)) / 2), 0) AS std_diff
      FROM ({_LAB_DIST}) a JOIN ({_LAB_DIST}) b ON a.covariate_id = b.covariate_id WHERE a.cohort_definition_id = 1 AND b.cohort_definition_id = 2""",
)
def _(cdm):
    labs = D.aggregate_measurements(D.measurement_values(cdm, cdm.cohort_rows, LABS_LONG))
    return T.continuous_differences(labs, 1, 2)


@query(
    "rank_by_abs_diff", "rank:l covariate_id:l std_diff:f",
    f"""SELECT row_number() OVER (ORDER BY round(abs(d), 9) DESC, covariate_id) AS rank, covariate_id, d AS std_diff FROM (
      SELECT covariate_id, (m1 - m2) / NULLIF(sqrt((m1 * (1 - m1) + m2 * (1 - m2)) / 2), 0) AS d FROM ({_BIN})) ORDER BY 1 LIMIT 20""",
)
def _(cdm):
    agg = D.aggregate_flags(D.domain_flags(cdm, cdm.cohort_rows, CONDITIONS), cdm.cohort_rows)
    return T.top_differences(T.binary_differences(agg, 1, 2), 20)


# --- study-specific -------------------------------------------------------------------
def _cohort_sql(value):
    return f"""SELECT a.row_id, 5{value[0]} AS covariate_id, {value[1]} AS covariate_value FROM cohort_rows a JOIN cohort b ON a.subject_id = b.subject_id AND b.cohort_definition_id = 4
      AND b.cohort_start_date <= a.cohort_start_date AND b.cohort_end_date >= a.cohort_start_date - 180 JOIN person ON person_id = a.subject_id GROUP BY a.row_id"""


@query(
    "cov_cohort", COV,
    " UNION ALL ".join(_cohort_sql(v) for v in (
        ("1", "1"), ("2", "count(DISTINCT b.cohort_start_date)"), ("3", "max(year(a.cohort_start_date) - year_of_birth)"),
        ("4", "ln(max(year(a.cohort_start_date) - year_of_birth))"))),
)
def _(cdm):
    out = None
    for cid, value in ((51, "flag"), (52, "count"), (53, "age"), (54, "ln_age")):
        f = C.cohort_covariate(cdm, cdm.cohort_rows, cdm.cohort, C.CohortCovariate(cid, 4, -180, 0, value))
        out = f if out is None else out.unionByName(f)
    return out


@query("cov_age_map", COV, f"SELECT row_id, 1458 AS covariate_id, CASE WHEN age < 40 THEN 0 ELSE (age - 40) / 10.0 END AS covariate_value FROM (SELECT row_id, year(cohort_start_date) - year_of_birth AS age {_PERSON})")
def _(cdm):
    return C.age_map_covariate(cdm, cdm.cohort_rows, lambda age: F.when(age < 40, 0.0).otherwise((age - 40) / 10.0))


_LAB_IDS = f"{P.ALT}, {P.AST}"
_MROWS = f"""SELECT row_id, cohort_definition_id, value_as_number AS raw, abs(date_diff('day', measurement_date, cohort_start_date)) AS dist, year(cohort_start_date) - year_of_birth AS age
  FROM cohort_rows JOIN measurement m ON subject_id = m.person_id AND measurement_date {_WINDOW} AND measurement_concept_id IN ({_LAB_IDS}) AND value_as_number IS NOT NULL JOIN person p ON p.person_id = subject_id"""
_REDUCERS = {
    "max": "max(raw)", "min": "min(raw)", "mean": "avg(raw)", "median": "median(raw)",
}


def _reduced(how):
    if how == "recent":
        return f"SELECT row_id, avg(raw) AS v FROM (SELECT *, min(dist) OVER (PARTITION BY row_id) AS md FROM ({_MROWS})) WHERE dist = md GROUP BY 1"
    return f"SELECT row_id, {_REDUCERS[how]} AS v FROM ({_MROWS}) GROUP BY 1"


def _spec(**kw):
    return C.MeasurementCovariate((P.ALT, P.AST), 1466, -365, 0, **kw)


for _how in ("max", "min", "mean", "median"):
    @query(f"reduce_{_how}", "row_id:l covariate_value:f", f"SELECT row_id, v AS covariate_value FROM ({_reduced(_how)})")
    def _(cdm, how=_how):
        return C.reduce_values(C.measurement_rows(cdm, cdm.cohort_rows, _spec()), how)


@query("measurement_most_recent", "row_id:l covariate_value:f", f"SELECT row_id, v AS covariate_value FROM ({_reduced('recent')})")
def _(cdm):
    return C.reduce_values(C.measurement_rows(cdm, cdm.cohort_rows, _spec()), "recent")


@query(
    "table1_measure", "covariate_id:l mean_value:f sd_value:f n:l",
    f"SELECT 1466 AS covariate_id, avg(v) AS mean_value, stddev_samp(v) AS sd_value, count(*) AS n FROM ({_reduced('recent')})",
)
def _(cdm):
    return C.table1_measure(C.reduce_values(C.measurement_rows(cdm, cdm.cohort_rows, _spec()), "recent"), 1466)


@query(
    "cov_measurement", COV,
    f"""SELECT r.row_id, 1466 AS covariate_id, COALESCE(v, ln(20.0) * ln(age)) AS covariate_value FROM (SELECT row_id, year(cohort_start_date) - year_of_birth AS age {_PERSON}) r
      LEFT JOIN (SELECT row_id, max(ln(age) * ln(raw) / 2) AS v FROM ({_MROWS}) WHERE raw > 0 GROUP BY 1) m ON m.row_id = r.row_id""",
)
def _(cdm):
    return C.measurement_covariate(cdm, cdm.cohort_rows, _spec(
        reduce="max", imputation=20.0, ln_value=True, ln_age_interaction=True, scale=lambda v: v / 2))


@query(
    "cov_measurement_impute", "variant:s row_id:l covariate_value:f",
    " UNION ALL ".join(f"SELECT '{n}' AS variant, row_id, {e} AS covariate_value FROM (SELECT row_id, year(cohort_start_date) - year_of_birth AS age {_PERSON}) WHERE row_id NOT IN (SELECT row_id FROM ({_MROWS}))"
                       for n, e in (("plain", "20.0"), ("age", "20.0 * age"), ("ln_age", "20.0 * ln(age)"), ("ln_value", "ln(20.0)"))),
)
def _(cdm):
    out = None
    for name, kw in (("plain", {}), ("age", {"age_interaction": True}), ("ln_age", {"ln_age_interaction": True}),
                     ("ln_value", {"ln_value": True})):
        spec = _spec(imputation=20.0, **kw)
        reduced = C.reduce_values(C.measurement_rows(cdm, cdm.cohort_rows, spec), "recent")
        f = C.impute_missing(cdm, cdm.cohort_rows, reduced, spec).withColumn("variant", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


_MEMBERS = """SELECT a.subject_id FROM cohort_rows a JOIN cohort b ON a.subject_id = b.subject_id AND b.cohort_definition_id = 4
  AND b.cohort_start_date <= a.cohort_start_date AND b.cohort_end_date >= a.cohort_start_date - 365"""


@query(
    "cov_measurement_cohort", "side:s row_id:l covariate_value:f",
    f"""SELECT 'in' AS side, row_id, avg(raw) AS covariate_value FROM ({_MROWS}) WHERE row_id // 1000000000 IN ({_MEMBERS}) GROUP BY 2
      UNION ALL SELECT 'out', row_id, avg(raw) FROM ({_MROWS}) WHERE row_id // 1000000000 NOT IN ({_MEMBERS}) GROUP BY 2""",
)
def _(cdm):
    out = None
    for side in ("in", "out"):
        f = C.measurement_cohort_covariate(
            cdm, cdm.cohort_rows, cdm.cohort, 4, _spec(reduce="mean"), side).withColumn("side", F.lit(side))
        out = f if out is None else out.unionByName(f)
    return out
