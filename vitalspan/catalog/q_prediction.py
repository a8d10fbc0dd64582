"""Study population, splits and performance measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalspan.catalog.oracle import VIEWS
from vitalspan.catalog.registry import query
from vitalspan.plans.covariates import demographics as G
from vitalspan.plans.covariates import domain as D
from vitalspan.plans.prediction import evaluate as E
from vitalspan.plans.prediction import features as X
from vitalspan.plans.prediction import population as N
from vitalspan.plans.prediction import split as S
from vitalspan.sources.derived import with_row_id

SPEC = N.PopulationSpec(remove_prior_outcome=False, min_time_at_risk=30)


def target_rows(cdm):
    rows = with_row_id(cdm.cohort.filter(F.col("cohort_definition_id") == 4))
    return N.plp_cohort(cdm, rows, N.TargetSpec(row_id="row_id"))


def population(cdm, spec=SPEC):
    return N.study_population(target_rows(cdm), N.outcome_days(cdm.cohort, [3]), 3, spec)


def scored(cdm):
    """Predictions of a fixed model: age and gender."""
    lp = -2.5 + 0.04 * F.col("age_year") + F.when(F.col("gender") == 8507, 0.35).otherwise(0.0)
    return population(cdm).withColumn("value", 1 / (1 + F.exp(-lp)))


def covariates(cdm, rows=None):
    """Gender, age band and prior conditions of the target rows."""
    rows = target_rows(cdm) if rows is None else rows
    out = None
    for f in (G.gender(cdm, rows), G.age_group(cdm, rows), D.domain_flags(cdm, rows, D.DomainAnalysis("condition_occurrence", 102))):
        f = f.select("row_id", "covariate_id", "covariate_value")
        out = f if out is None else out.unionByName(f)
    return out


def _target_sql(cid=4, first=False):
    src = "cohort_all_rows"
    return f"""SELECT row_id, subject_id, cohort_definition_id, cohort_start_date, cohort_end_date, date_diff('day', observation_period_start_date, cohort_start_date) AS dfos,
      date_diff('day', cohort_start_date, cohort_end_date) AS dtce, date_diff('day', cohort_start_date, observation_period_end_date) AS dtoe, year(cohort_start_date) - year_of_birth AS age_year, gender_concept_id AS gender
      FROM {src} JOIN observation_period o ON o.person_id = subject_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date JOIN person p ON p.person_id = subject_id WHERE cohort_definition_id = {cid}"""


def _flag_sql(spec: N.PopulationSpec) -> str:
    s = f"{'dtce + ' if spec.start_anchor == 'cohort end' else ''}{spec.risk_start}"
    e = f"{'dtce + ' if spec.end_anchor == 'cohort end' else ''}{spec.risk_end}"
    enough = f"te - ts >= {spec.min_time_at_risk}" + (" OR inside > 0" if spec.include_all_outcomes else "")
    tests = ["TRUE", "cohort_start_date = min(cohort_start_date) OVER (PARTITION BY subject_id)" if spec.first_exposure_only else "TRUE",
             f"dfos >= {spec.washout_days}", "before = 0" if spec.remove_prior_outcome else "TRUE", "te - ts >= 0",
             f"({enough})" if spec.require_time_at_risk else "TRUE"]
    flags = ", ".join(" AND ".join(tests[:i + 1]) + f" AS s{i}" for i in range(6))
    return f"""SELECT *, CASE WHEN inside > 0 THEN 1 ELSE 0 END AS outcome_count, COALESCE(firstin, te) - ts + 1 AS survival_time, {flags} FROM (
      SELECT t.*, (SELECT count(*) FROM outc o WHERE o.row_id = t.row_id AND dte BETWEEN ts AND te) AS inside, (SELECT min(dte) FROM outc o WHERE o.row_id = t.row_id AND dte BETWEEN ts AND te) AS firstin,
        (SELECT count(*) FROM outc o WHERE o.row_id = t.row_id AND dte < ts AND dte >= ts - {spec.prior_lookback}) AS before
      FROM (SELECT *, {s} AS ts, LEAST({e}, dtoe) AS te FROM target) t)"""


PV = {
    "target": _target_sql(),
    "outc": """SELECT DISTINCT row_id, 3 AS outcome_id, date_diff('day', t.cohort_start_date, o.cohort_start_date) AS dte FROM target t JOIN cohort o ON o.subject_id = t.subject_id AND o.cohort_definition_id = 3
      WHERE date_diff('day', o.cohort_start_date, t.cohort_start_date) <= dfos AND date_diff('day', t.cohort_start_date, o.cohort_start_date) <= dtoe""",
    "popn": f"SELECT * FROM ({_flag_sql(SPEC)}) WHERE s5",
    "pred": "SELECT *, 1 / (1 + exp(-(-2.5::DOUBLE + 0.04::DOUBLE * age_year + CASE WHEN gender = 8507 THEN 0.35::DOUBLE ELSE 0::DOUBLE END))) AS value FROM popn",
    "covs": """SELECT row_id, gender * 1000 + 1 AS covariate_id, 1.0::DOUBLE AS covariate_value FROM target UNION ALL SELECT row_id, (age_year // 5) * 1000 + 3, 1 FROM target
      UNION ALL SELECT DISTINCT row_id, condition_concept_id * 1000 + 102, 1 FROM target JOIN condition_occurrence ON person_id = subject_id AND condition_start_date BETWEEN cohort_start_date - 365 AND cohort_start_date""",
    "scoreg": "SELECT value, sum(outcome_count) AS pos, sum(1 - outcome_count) AS neg FROM pred GROUP BY 1",
}
assert not set(PV) & set(VIEWS)

_TARGET = "row_id:l subject_id:l cohort_start_date:d days_from_obs_start:l days_to_cohort_end:l days_to_obs_end:l age_year:l gender:l"


@query(
    "plp_cohort", _TARGET,
    """SELECT row_number() OVER (ORDER BY subject_id, cohort_start_date) AS row_id, subject_id, cohort_start_date, date_diff('day', observation_period_start_date, cohort_start_date) AS days_from_obs_start,
       date_diff('day', cohort_start_date, LEAST(ced, DATE '2000-01-01')) AS days_to_cohort_end, date_diff('day', cohort_start_date, LEAST(observation_period_end_date, DATE '2000-01-01')) AS days_to_obs_end,
       year(cohort_start_date) - year_of_birth AS age_year, gender_concept_id AS gender
       FROM (SELECT subject_id, min(cohort_start_date) AS cohort_start_date, min(cohort_end_date) AS ced FROM cohort WHERE cohort_definition_id = 4 GROUP BY 1)
       JOIN observation_period o ON o.person_id = subject_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date JOIN person p ON p.person_id = subject_id
       WHERE cohort_start_date >= DATE '1996-01-01' AND cohort_start_date < DATE '2000-01-01' AND date_diff('day', observation_period_start_date, cohort_start_date) >= 60""",
)
def _(cdm):
    spec = N.TargetSpec(first_only=True, washout_days=60, study_start="1996-01-01", study_end="2000-01-01")
    return N.plp_cohort(cdm, cdm.cohort.filter(F.col("cohort_definition_id") == 4), spec)


@query("plp_outcomes", "row_id:l outcome_id:l days_to_event:l", "SELECT row_id, outcome_id, dte AS days_to_event FROM outc", PV)
def _(cdm):
    return N.plp_outcomes(target_rows(cdm), cdm.cohort, [3])


_POP = "row_id:l tar_start:l tar_end:l outcome_count:l survival_time:l"
_POP_SQL = "row_id, ts AS tar_start, te AS tar_end, outcome_count, survival_time"
STRICT = N.PopulationSpec(
    washout_days=180, first_exposure_only=True, prior_lookback=60, risk_start=1, risk_end=60, end_anchor="cohort end",
    min_time_at_risk=59)


@query("study_population", _POP, f"SELECT {_POP_SQL} FROM ({_flag_sql(STRICT)}) WHERE s5", PV)
def _(cdm):
    return population(cdm, STRICT)


@query(
    "population_variants", "variant:s rows:l outcomes:l",
    " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) AS rows, sum(outcome_count) AS outcomes FROM ({_flag_sql(s)}) WHERE s5" for n, s in N.population_variants(SPEC).items()), PV,
)
def _(cdm):
    rows, events, out = target_rows(cdm), N.outcome_days(cdm.cohort, [3]), None
    for name, spec in N.population_variants(SPEC).items():
        f = N.study_population(rows, events, 3, spec).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("outcome_count").alias("outcomes")).withColumn("variant", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


_ATTRITION = " UNION ALL ".join(
    f"SELECT {i} AS step, '{s}' AS description, count(*) AS target_count, count(DISTINCT subject_id) AS unique_people, sum(outcome_count) AS outcomes FROM ({_flag_sql(STRICT)}) WHERE s{i}" for i, s in enumerate(N.STEPS))


@query("attrition", "step:l description:s target_count:l unique_people:l outcomes:l", _ATTRITION, PV)
def _(cdm):
    return N.attrition(target_rows(cdm), N.outcome_days(cdm.cohort, [3]), 3, STRICT)


# --- splits ---------------------------------------------------------------------
def _assign_sql(units: str, unit: str, seed: int = 1, frac: float = .25, folds: int = 3) -> str:
    return f"""SELECT {unit}, CASE WHEN rn <= nt THEN -1 ELSE (rn - nt - 1) % {folds} + 1 END AS index FROM (SELECT {unit}, row_number() OVER (PARTITION BY cls ORDER BY md5({unit} || '|{seed}')) AS rn,
      CAST(floor(count(*) OVER (PARTITION BY cls) * {frac}) AS BIGINT) AS nt FROM ({units}))"""


_IDX = "row_id:l index:l"
_STRAT = _assign_sql("SELECT row_id, outcome_count AS cls FROM popn", "row_id")


@query("split_stratified", _IDX, _STRAT, PV)
def _(cdm):
    return S.split(population(cdm), S.SplitSpec())


@query("split_subject", _IDX, f"SELECT row_id, index FROM popn JOIN ({_assign_sql('SELECT subject_id, max(outcome_count) AS cls FROM popn GROUP BY 1', 'subject_id')}) s ON s.subject_id = popn.subject_id", PV)
def _(cdm):
    return S.split(population(cdm), S.SplitSpec("subject"))


_FRACTION = "(CAST('0x' || substr(md5(row_id || '|{seed}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


@query(
    "split_time", _IDX,
    f"""WITH q AS (SELECT quantile_disc(cohort_start_date, 0.75) AS cut FROM popn)
      SELECT row_id, CASE WHEN cohort_start_date > cut THEN -1 ELSE CAST(floor({_FRACTION.format(seed=1)} * 3) AS BIGINT) + 1 END AS index FROM popn, q""", PV,
)
def _(cdm):
    return S.split(population(cdm), S.SplitSpec("time"))


@query("split_custom", _IDX, "SELECT row_id, CASE WHEN age_year > 60 THEN -1 ELSE 1 + month(cohort_start_date) % 3 END AS index FROM popn", PV)
def _(cdm):
    def by_age(pop):
        return pop.select("row_id", F.when(F.col("age_year") > 60, -1).otherwise(1 + F.month("cohort_start_date") % 3).alias("index"))

    return S.split(population(cdm), S.SplitSpec("custom", custom=by_age))


@query(
    "undersample", "row_id:l outcome_count:l",
    """SELECT row_id, outcome_count FROM popn WHERE outcome_count > 0 UNION ALL SELECT row_id, outcome_count FROM (SELECT *, row_number() OVER (ORDER BY md5(row_id || '|0')) AS rn FROM popn WHERE outcome_count = 0)
       WHERE rn <= (SELECT floor(sum(outcome_count) * 0.5) FROM popn)""", PV,
)
def _(cdm):
    return S.undersample(population(cdm), 0.5)


@query(
    "random_sample_n", "row_id:l outcome_count:l index:l covariates:l",
    f"""SELECT p.row_id, outcome_count, index, count(covariate_id) AS covariates FROM (SELECT * FROM popn ORDER BY md5(row_id || '|0') LIMIT 200) p JOIN ({_STRAT}) s ON s.row_id = p.row_id JOIN covs c ON c.row_id = p.row_id GROUP BY 1, 2, 3""", PV,
)
def _(cdm):
    pop = population(cdm)
    kept = S.random_sample_n(pop, {"folds": S.split(pop, S.SplitSpec()), "covariates": covariates(cdm)}, 200)
    counts = kept["covariates"].groupBy("row_id").agg(F.count(F.lit(1)).alias("covariates"))
    return kept["labels"].join(kept["folds"], "row_id").join(counts, "row_id")


# --- features ---------------------------------------------------------------------
@query(
    "feature_select_univariate", "covariate_id:l statistic:f",
    """WITH n AS (SELECT count(*) AS t, sum(outcome_count) AS p FROM popn), c AS (SELECT covariate_id, count(*) AS a1, sum(outcome_count) AS a FROM covs JOIN popn ON popn.row_id = covs.row_id GROUP BY 1)
       SELECT covariate_id, t * power(a * ((t - a1) - (p - a)) - (a1 - a) * (p - a), 2) / NULLIF((a1 * (t - a1) * p * (t - p))::DOUBLE, 0) AS statistic FROM c, n ORDER BY round(statistic, 9) DESC NULLS LAST, covariate_id LIMIT 15""", PV,
)
def _(cdm):
    return X.select_univariate(covariates(cdm), population(cdm), 15)


@query("map_ids", "kind:s old_id:l new_id:l", "SELECT DISTINCT 'row' AS kind, row_id AS old_id, dense_rank() OVER (ORDER BY row_id) AS new_id FROM covs UNION ALL SELECT DISTINCT 'covariate', covariate_id, dense_rank() OVER (ORDER BY covariate_id) FROM covs", PV)
def _(cdm):
    rows, columns = X.map_ids(covariates(cdm))
    return rows.select(F.lit("row").alias("kind"), F.col("row_id").alias("old_id"), F.col("new_row_id").alias("new_id")).unionByName(
        columns.select(F.lit("covariate").alias("kind"), F.col("covariate_id").alias("old_id"), F.col("new_covariate_id").alias("new_id")))


@query("to_sparse", "row_id:l size:l nonzero:l total:f", "SELECT row_id, (SELECT count(DISTINCT covariate_id) FROM covs) AS size, count(*) AS nonzero, sum(covariate_value) AS total FROM covs GROUP BY 1", PV)
def _(cdm):
    from pyspark.ml.functions import vector_to_array
    vectors, _ids = X.to_vectors(covariates(cdm))
    arr = vector_to_array("features")
    return vectors.select(
        "row_id", F.size(arr).alias("size"), F.size(F.filter(arr, lambda v: v != 0)).alias("nonzero"),
        F.aggregate(arr, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("discretise_age", "row_id:l decade:l old:b", "SELECT row_id, CAST(round(age_year / 10.0) AS BIGINT) AS decade, age_year > 30 AS old FROM popn", PV)
def _(cdm):
    return X.discretise_age(population(cdm), 30)


@query(
    "one_hot_matrix", "feature:s rows:l",
    """SELECT 'segment=' || c_mktsegment AS feature, count(*) AS rows FROM popn JOIN customer ON c_custkey = subject_id GROUP BY 1 UNION ALL SELECT 'gender=' || gender, count(*) FROM popn GROUP BY 1""", PV,
)
def _(cdm):
    from pyspark.ml.functions import vector_to_array
    rows = population(cdm).join(cdm.customer, F.col("subject_id") == F.col("c_custkey")).select(
        "row_id", F.col("c_mktsegment").alias("segment"), F.col("gender").cast("string").alias("gender"))
    encoded, names = X.one_hot(rows, ["segment", "gender"])
    arr = vector_to_array("features")
    labels = F.array(*[F.lit(n) for n in names])
    hits = encoded.select(F.explode(F.filter(F.arrays_zip(arr.alias("v"), labels.alias("f")), lambda z: z["v"] != 0)).alias("z"))
    return hits.groupBy(F.col("z.f").alias("feature")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "chisq_test", "feature:s statistic:f degrees:l",
    """WITH c AS (SELECT gender AS g, outcome_count AS y, count(*) AS n FROM popn GROUP BY 1, 2), r AS (SELECT g, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS kn FROM c GROUP BY 1), t AS (SELECT sum(n) AS tn FROM c)
       SELECT 'gender' AS feature, sum(power(COALESCE(n, 0) - rn * kn / tn::DOUBLE, 2) / (rn * kn / tn::DOUBLE)) AS statistic, (SELECT (count(DISTINCT g) - 1) * (count(DISTINCT y) - 1) FROM c) AS degrees
       FROM r, k, t LEFT JOIN c ON c.g = r.g AND c.y = k.y""", PV,
)
def _(cdm):
    return X.chi_square(population(cdm), ["gender"])


# --- measures ----------------------------------------------------------------------
@query("auc", "auc:f", "SELECT sum(pos * (COALESCE(b, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM scoreg)", PV)
def _(cdm):
    return E.auc(scored(cdm))


@query("auprc", "auprc:f", "SELECT sum(pos * cp / (cp + cn)) / sum(pos) AS auprc FROM (SELECT *, sum(pos) OVER (ORDER BY value DESC)::DOUBLE AS cp, sum(neg) OVER (ORDER BY value DESC)::DOUBLE AS cn FROM scoreg)", PV)
def _(cdm):
    return E.auprc(scored(cdm))


@query("brier", "brier:f scaled_brier:f", "SELECT avg(power(outcome_count - value, 2)) AS brier, 1 - avg(power(outcome_count - value, 2)) / (avg(outcome_count) * (1 - avg(outcome_count))) AS scaled_brier FROM pred", PV)
def _(cdm):
    return E.brier(scored(cdm))


_TS = ("prediction_threshold:f preference_threshold:f positive_count:l negative_count:l true_count:l false_count:l true_positive_count:l true_negative_count:l "
       "false_positive_count:l false_negative_count:l f_1_score:f accuracy:f sensitivity:f false_negative_rate:f false_positive_rate:f specificity:f positive_predictive_value:f "
       "false_discovery_rate:f negative_predictive_value:f false_omission_rate:f positive_likelihood_ratio:f negative_likelihood_ratio:f diagnostic_odds_ratio:f")


@query(
    "threshold_summary", _TS,
    """SELECT value AS prediction_threshold, 1 / (1 + exp(-(ln(value / (1 - value)) - ln((p / (p + n)) / (1 - p / (p + n)))))) AS preference_threshold, tp + fp AS positive_count, tn + fn AS negative_count, p AS true_count, n AS false_count,
       tp AS true_positive_count, tn AS true_negative_count, fp AS false_positive_count, fn AS false_negative_count, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f_1_score, (tp + tn) / (p + n) AS accuracy, tp / p AS sensitivity, fn / p AS false_negative_rate,
       fp / n AS false_positive_rate, tn / n AS specificity, tp / (tp + fp) AS positive_predictive_value, fp / (tp + fp) AS false_discovery_rate, tn / NULLIF(tn + fn, 0) AS negative_predictive_value, fn / NULLIF(tn + fn, 0) AS false_omission_rate,
       (tp / p) / NULLIF(fp / n, 0) AS positive_likelihood_ratio, (fn / p) / NULLIF(tn / n, 0) AS negative_likelihood_ratio, ((tp / p) / NULLIF(fp / n, 0)) / NULLIF((fn / p) / NULLIF(tn / n, 0), 0) AS diagnostic_odds_ratio
       FROM (SELECT *, p - tp AS fn, n - fp AS tn FROM (SELECT value, sum(pos) OVER (ORDER BY value DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY value DESC)::DOUBLE AS fp, sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n FROM scoreg))""", PV,
)
def _(cdm):
    return E.threshold_summary(scored(cdm))


@query("preference_score", "row_id:l preference:f", "SELECT row_id, 1 / (1 + exp(-(ln(value / (1 - value)) - ln(r / (1 - r))))) AS preference FROM pred, (SELECT avg(outcome_count) AS r FROM popn)", PV)
def _(cdm):
    pred = scored(cdm)
    rate = pred.agg(F.avg(F.col("outcome_count").cast("double"))).scalar()
    return pred.select("row_id", E.preference_score(F.col("value"), rate).alias("preference"))


def _spread_sql(keys, source, qs):
    cont = ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in qs)
    return f"SELECT {keys}, count(*) AS person_count, sum(outcome_count) AS outcomes, avg(value) AS average, stddev_samp(value) AS st_dev, min(value) AS min, max(value) AS max, {cont} FROM {source} GROUP BY {keys}"


_BINNED = "(SELECT *, ntile(10) OVER (ORDER BY value, row_id) AS bin FROM pred)"
_SP = "person_count:l outcomes:l average:f st_dev:f min:f max:f"


@query("calibration_summary", f"bin:l {_SP} p_25:f median:f p_75:f observed_incidence:f", f"SELECT *, outcomes / person_count AS observed_incidence FROM ({_spread_sql('bin', _BINNED, (('p_25', .25), ('median', .5), ('p_75', .75)))})", PV)
def _(cdm):
    return E.calibration_summary(scored(cdm))


@query(
    "calibration_line", "slope:f intercept:f mean_predicted:f mean_observed:f",
    f"SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, (SELECT avg(value) FROM pred) AS mean_predicted, (SELECT avg(outcome_count) FROM pred) AS mean_observed FROM (SELECT bin, avg(value) AS x, avg(outcome_count) AS y FROM {_BINNED} GROUP BY 1)", PV,
)
def _(cdm):
    return E.calibration_line(scored(cdm))


@query(
    "ici", "ici:f",
    """WITH g AS (SELECT floor(ln(value) * 2048) AS b, avg(value) AS x, avg(outcome_count) AS y, count(*)::DOUBLE AS w FROM pred GROUP BY 1),
      p AS (SELECT a.b, a.x, a.w AS w0, c.x - a.x AS d, abs(c.x - a.x) AS far, c.y, c.w, sum(c.w) OVER (PARTITION BY a.b ORDER BY abs(c.x - a.x) RANGE UNBOUNDED PRECEDING) AS cw FROM g a CROSS JOIN g c),
      h AS (SELECT b, min(far) AS h FROM p WHERE cw >= (SELECT ceil(0.75 * sum(w)) FROM g) GROUP BY 1),
      u AS (SELECT p.b, x, w0, y, d / h AS u, w * pow(1 - pow(far / h, 3), 3) AS k FROM p JOIN h ON h.b = p.b WHERE far < h),
      m AS (SELECT b, any_value(x) AS x, any_value(w0) AS w, sum(k) AS a0, sum(k * u) AS a1, sum(k * u * u) AS a2, sum(k * u ** 3) AS a3, sum(k * u ** 4) AS a4, sum(k * y) AS r0, sum(k * y * u) AS r1, sum(k * y * u * u) AS r2 FROM u GROUP BY 1),
      s AS (SELECT x, w, (r0 * (a2 * a4 - a3 * a3) - a1 * (r1 * a4 - a3 * r2) + a2 * (r1 * a3 - a2 * r2)) / (a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a3 * a2) + a2 * (a1 * a3 - a2 * a2)) AS smooth FROM m)
      SELECT sum(w * abs(x - smooth)) / sum(w) AS ici FROM s""", PV,
)
def _(cdm):
    return E.ici(scored(cdm))


@query("demographic_summary", f"age_group:l gender:l {_SP} p_25:f p_50:f p_75:f", _spread_sql("age_group, gender", "(SELECT *, (age_year // 5) * 5 AS age_group FROM pred)", (("p_25", .25), ("p_50", .5), ("p_75", .75))), PV)
def _(cdm):
    return E.demographic_summary(scored(cdm))


@query("prediction_distribution", f"class_label:l {_SP} p_05:f p_25:f median:f p_75:f p_95:f", _spread_sql("class_label", "(SELECT *, outcome_count AS class_label FROM pred)", (("p_05", .05), ("p_25", .25), ("median", .5), ("p_75", .75), ("p_95", .95))), PV)
def _(cdm):
    return E.prediction_distribution(scored(cdm))


def _cs(tag, cond, prefix):
    return f"sum(CASE WHEN {cond} AND v <> 0 THEN 1 ELSE 0 END) AS {prefix}covariate_count, avg(CASE WHEN {cond} THEN v END) AS {prefix}covariate_mean, stddev_samp(CASE WHEN {cond} THEN v END) AS {prefix}covariate_st_dev"


@query(
    "covariate_summary", "covariate_id:l covariate_count:l covariate_mean:f covariate_st_dev:f with_no_outcome_covariate_count:l with_no_outcome_covariate_mean:f with_no_outcome_covariate_st_dev:f with_outcome_covariate_count:l with_outcome_covariate_mean:f with_outcome_covariate_st_dev:f standardized_mean_diff:f",
    f"""SELECT *, (with_outcome_covariate_mean - with_no_outcome_covariate_mean) / NULLIF(sqrt((power(with_outcome_covariate_st_dev, 2) + power(with_no_outcome_covariate_st_dev, 2)) / 2), 0) AS standardized_mean_diff FROM (
      SELECT covariate_id, {_cs('a', 'TRUE', '')}, {_cs('0', 'outcome_count = 0', 'with_no_outcome_')}, {_cs('1', 'outcome_count = 1', 'with_outcome_')}
      FROM (SELECT i.covariate_id, outcome_count, COALESCE(covariate_value, 0) AS v FROM (SELECT DISTINCT covariate_id FROM covs JOIN popn ON popn.row_id = covs.row_id) i CROSS JOIN popn p LEFT JOIN covs c ON c.row_id = p.row_id AND c.covariate_id = i.covariate_id) GROUP BY 1)""", PV,
)
def _(cdm):
    return E.covariate_summary(covariates(cdm), population(cdm))


@query(
    "generalizability", "covariate_id:l train_mean:f test_mean:f",
    f"""WITH s AS ({_STRAT}), z AS (SELECT sum((index > 0)::INT) AS ntrain, sum((index < 0)::INT) AS ntest FROM s)
      SELECT covariate_id, sum(CASE WHEN index > 0 THEN covariate_value ELSE 0 END) / any_value(ntrain) AS train_mean, sum(CASE WHEN index < 0 THEN covariate_value ELSE 0 END) / any_value(ntest) AS test_mean FROM covs JOIN s ON s.row_id = covs.row_id, z GROUP BY 1""", PV,
)
def _(cdm):
    return E.generalizability(covariates(cdm), S.split(population(cdm), S.SplitSpec()))


@query(
    "survival_curve", "day:l at_risk:l events:l survival:f",
    """SELECT day, at_risk, events, CASE WHEN sum((events = at_risk)::INT) OVER w > 0 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival FROM (
       SELECT day, (SELECT count(*) FROM popn WHERE survival_time >= day) AS at_risk, events FROM (SELECT survival_time AS day, sum(outcome_count) AS events FROM popn GROUP BY 1)) WINDOW w AS (ORDER BY day)""", PV,
)
def _(cdm):
    return E.survival_curve(population(cdm))


_TREND = " UNION ALL ".join(f"SELECT '{k}' AS aggregation, {c} AS xvalue, avg(outcome_count) * 100 AS outcome_percent, count(*) AS rows FROM popn GROUP BY 2" for k, c in (("age", "age_year"), ("gender", "gender"), ("year", "year(cohort_start_date)")))


@query("outcome_rate_trend", "aggregation:s xvalue:l outcome_percent:f rows:l", _TREND, PV)
def _(cdm):
    return E.outcome_rate_trend(population(cdm))


@query(
    "diagnose_design", "area:s metric:s value:f",
    f"""SELECT 'participants' AS area, metric, value FROM (UNPIVOT (SELECT count(*)::DOUBLE AS rows, count(DISTINCT subject_id)::DOUBLE AS people, sum(outcome_count)::DOUBLE AS outcomes, avg(outcome_count) * 100 AS outcome_percent, min(age_year)::DOUBLE AS min_age, max(age_year)::DOUBLE AS max_age FROM popn)
        ON rows, people, outcomes, outcome_percent, min_age, max_age INTO NAME metric VALUE value)
      UNION ALL SELECT 'outcome_trend', 'lowest_year', min(outcome_percent) FROM ({_TREND}) WHERE aggregation = 'year' UNION ALL SELECT 'outcome_trend', 'highest_year', max(outcome_percent) FROM ({_TREND}) WHERE aggregation = 'year'
      UNION ALL SELECT 'attrition', description, target_count FROM ({_ATTRITION})""", PV,
)
def _(cdm):
    return E.diagnose_design(population(cdm), N.attrition(target_rows(cdm), N.outcome_days(cdm.cohort, [3]), 3, STRICT))


_NEWTON = """WITH RECURSIVE g AS (SELECT ln(value / (1 - value)) AS x, pos, pos + neg AS m FROM scoreg), nw(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, {step} FROM (SELECT i, a, b, sum(r) AS g0, sum(r * x) AS g1, sum(w) AS h00, sum(w * x) AS h01, sum(w * x * x) AS h11 FROM
    (SELECT i, a, b, x, pos - m * (1 / (1 + exp(-(a + b * x)))) AS r, m * (1 / (1 + exp(-(a + b * x)))) * (1 - 1 / (1 + exp(-(a + b * x)))) AS w FROM nw, g WHERE i < 15) GROUP BY i, a, b))"""
_WEAK = _NEWTON.format(step="a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)")
_LARGE = _NEWTON.format(step="a + g0 / h00, b")


@query("recalibrate_weak", "row_id:l value:f", f"{_WEAK} SELECT row_id, 1 / (1 + exp(-(a + b * ln(value / (1 - value))))) AS value FROM pred, (SELECT a, b FROM nw ORDER BY i DESC LIMIT 1)", PV)
def _(cdm):
    return E.recalibrate_weak(scored(cdm))[0]


@query("recalibrate_in_large", "row_id:l value:f", f"{_LARGE} SELECT row_id, 1 / (1 + exp(-(a + b * ln(value / (1 - value))))) AS value FROM pred, (SELECT a, b FROM nw ORDER BY i DESC LIMIT 1)", PV)
def _(cdm):
    return E.recalibrate_in_large(scored(cdm))[0]


@query(
    "model_concordance", "concordance:f",
    """SELECT sum(a.value * (1 - b.value) * a.m * (b.m - CASE WHEN a.value = b.value THEN 1 ELSE 0 END) * CASE WHEN a.value > b.value THEN 1 WHEN a.value = b.value THEN 0.5 ELSE 0 END)
       / sum(a.value * (1 - b.value) * a.m * (b.m - CASE WHEN a.value = b.value THEN 1 ELSE 0 END)) AS concordance
       FROM (SELECT value, count(*) AS m FROM pred GROUP BY 1) a, (SELECT value, count(*) AS m FROM pred GROUP BY 1) b""", PV,
)
def _(cdm):
    return E.model_concordance(scored(cdm))


# Coefficients by rule: -3..3 tenths by covariate id, intercept -1.
def _coefficients(cdm):
    return covariates(cdm).select("covariate_id").distinct().withColumn(
        "coefficient", ((F.floor(F.col("covariate_id") / 1000) % 7) - 3) / 10.0)


@query(
    "predict", "row_id:l outcome_count:l value:f",
    "SELECT p.row_id, outcome_count, 1 / (1 + exp(-(-1 + COALESCE(lp, 0)))) AS value FROM popn p LEFT JOIN (SELECT row_id, sum(covariate_value * ((covariate_id // 1000) % 7 - 3) / 10.0::DOUBLE) AS lp FROM covs GROUP BY 1) c ON c.row_id = p.row_id", PV,
)
def _(cdm):
    from vitalspan.plans.prediction.models import LinearScorer
    return LinearScorer(_coefficients(cdm), -1.0).predict(covariates(cdm), population(cdm))


@query(
    "pfi", "covariate_id:l importance:f",
    """WITH lp AS (SELECT p.row_id, outcome_count AS y, -1 + COALESCE(sum(covariate_value * ((covariate_id // 1000) % 7 - 3) / 10.0::DOUBLE), 0) AS lp FROM popn p LEFT JOIN covs c ON c.row_id = p.row_id GROUP BY 1, 2),
      a AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn FROM popn), h AS (SELECT row_id AS donor, row_number() OVER (ORDER BY md5(row_id || '|7')) AS rn FROM popn), m AS (SELECT row_id, donor FROM a JOIN h ON a.rn = h.rn),
      f AS (SELECT * FROM (VALUES (8507001), (8532001), (4000001102), (4000002102), (4000003102)) AS v(covariate_id)),
      s AS (SELECT f.covariate_id, y, round(lp + ((f.covariate_id // 1000) % 7 - 3) / 10.0::DOUBLE * (COALESCE(d.covariate_value, 0) - COALESCE(o.covariate_value, 0)), 9) AS lp FROM lp CROSS JOIN f JOIN m ON m.row_id = lp.row_id
        LEFT JOIN covs d ON d.row_id = donor AND d.covariate_id = f.covariate_id LEFT JOIN covs o ON o.row_id = lp.row_id AND o.covariate_id = f.covariate_id UNION ALL SELECT 0, y, round(lp, 9) FROM lp),
      g AS (SELECT covariate_id, lp, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2),
      u AS (SELECT covariate_id, sum(pos * (COALESCE(b, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY covariate_id ORDER BY lp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g) GROUP BY 1)
      SELECT covariate_id, (SELECT auc FROM u WHERE covariate_id = 0) - auc AS importance FROM u WHERE covariate_id <> 0""", PV,
)
def _(cdm):
    from vitalspan.plans.prediction.models import LinearScorer, permutation_importance
    scorer = LinearScorer(_coefficients(cdm), -1.0)
    return permutation_importance(scorer, covariates(cdm), population(cdm), [8507001, 8532001, 4000001102, 4000002102, 4000003102], seed=7)
