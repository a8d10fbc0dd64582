"""Learners and their surrounding jobs."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import classification as MC
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.catalog.q_prediction import _STRAT, PV, SPEC, _flag_sql, _target_sql, covariates, population, scored, target_rows
from vitalspan.catalog.registry import query
from vitalspan.operators.ranks import running_totals
from vitalspan.plans.prediction import evaluate as E
from vitalspan.plans.prediction import features as X
from vitalspan.plans.prediction import models as M
from vitalspan.plans.prediction import multi as U
from vitalspan.plans.prediction import population as N
from vitalspan.plans.prediction import sparse as P
from vitalspan.plans.prediction import split as S
from vitalspan.session import literal_frame, materialize, scratch_path
from vitalspan.sources.derived import with_row_id

PRED = "row_id:l index:l outcome_count:l value:f"


def data(cdm):
    """Covariates and split population, written once per query."""
    pop = population(cdm)
    pop = materialize(pop.join(S.split(pop, S.SplitSpec()), "row_id"), "population")
    return materialize(covariates(cdm), "covariates"), pop


def _fit_predict(learn):
    def plan(cdm):
        cov, pop = data(cdm)
        return learn(cov, pop.filter(F.col("index") > 0)).predict(cov, pop)

    return plan


for _name, _kind in (("fit_gbm", "gbm"), ("fit_rf", "rf"), ("fit_dt", "dt"), ("fit_svm", "svm")):
    query(_name, PRED)(_fit_predict(lambda c, p, k=_kind: M.fit(c, p, M.ModelSpec(k))))

_SPLIT_CTE = f"sp AS (SELECT popn.*, index FROM popn JOIN ({_STRAT}) s ON s.row_id = popn.row_id)"
_SUM = "name:s rows:l observed:f fitted:f"


@query(
    "fit_nb", PRED,
    f"""WITH {_SPLIT_CTE}, tr AS (SELECT row_id, outcome_count AS y FROM sp WHERE index > 0),
      cells AS (SELECT y, covariate_id, sum(covariate_value) AS s FROM tr JOIN covs c ON c.row_id = tr.row_id GROUP BY 1, 2),
      names AS (SELECT DISTINCT covariate_id FROM cells), classes AS (SELECT y, count(*) AS n FROM tr GROUP BY 1),
      theta AS (SELECT k.y, f.covariate_id, ln((COALESCE(s, 0) + 1.0::DOUBLE) / ((SELECT COALESCE(sum(s), 0) FROM cells z WHERE z.y = k.y) + (SELECT count(*) FROM names))) AS t
        FROM classes k CROSS JOIN names f LEFT JOIN cells c ON c.y = k.y AND c.covariate_id = f.covariate_id),
      raw AS (SELECT sp.row_id, k.y, any_value(ln((n + 1.0::DOUBLE) / ((SELECT count(*) FROM tr) + 2))) + COALESCE(sum(covariate_value * t), 0) AS v
        FROM sp CROSS JOIN classes k LEFT JOIN (covs c JOIN theta h ON h.covariate_id = c.covariate_id) ON c.row_id = sp.row_id AND h.y = k.y GROUP BY 1, 2)
      SELECT sp.row_id, index, outcome_count, 1 / (1 + exp(a.v - b.v)) AS value FROM sp JOIN raw a ON a.row_id = sp.row_id AND a.y = 0 JOIN raw b ON b.row_id = sp.row_id AND b.y = 1""", PV,
)
def _(cdm):
    return _fit_predict(lambda c, p: M.fit(c, p, M.ModelSpec("nb")))(cdm)


def optimality(covariates: DataFrame, scored: DataFrame, weights: DataFrame, limit: float) -> DataFrame:
    """Per covariate the observed sum of its values over outcomes, and the sum
    fitted by ``value`` plus what the penalty holds back. At the optimum, and
    only there, both are equal. Covariate 0 is the free constant."""
    values = covariates.select("row_id", "covariate_id", "covariate_value").unionByName(
        scored.select("row_id", F.lit(0).cast("long").alias("covariate_id"), F.lit(1.0).alias("covariate_value")))
    sums = values.join(scored.select("row_id", "outcome_count", "value"), "row_id").groupBy("covariate_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("covariate_value") * F.col("outcome_count")).alias("observed"),
        F.sum(F.col("covariate_value") * F.col("value")).alias("fitted"))
    gap = F.col("observed") - F.col("fitted")
    inside = F.greatest(F.least(gap, F.lit(limit)), F.lit(-limit))
    held = F.when(F.col("covariate_id") == 0, 0.0).when(F.col("coefficient").isNull(), inside).otherwise(F.signum("coefficient") * limit)
    return sums.join(weights, "covariate_id", "left").select(F.col("covariate_id").cast("string").alias("name"), "rows", "observed", (F.col("fitted") + held).alias("fitted"))


_TRAIN_SUMS = f"""WITH {_SPLIT_CTE}, tr AS (SELECT * FROM sp WHERE index > 0)
  SELECT CAST(covariate_id AS VARCHAR) AS name, count(*) AS rows, sum(covariate_value * outcome_count) AS observed, sum(covariate_value * outcome_count) AS fitted
  FROM (SELECT row_id, covariate_id, covariate_value FROM covs UNION ALL SELECT row_id, 0, 1 FROM tr) c JOIN tr ON tr.row_id = c.row_id GROUP BY 1"""


@query("fit_lasso_lr", _SUM, _TRAIN_SUMS, PV)
def _(cdm):
    """Optimality of the lasso whose penalty the folds chose, summed anew from
    its written coefficients."""
    cov, pop = data(cdm)
    train = pop.filter(F.col("index") > 0)
    scorer, path = M.fit_lasso_path(cov, train, F.col("index"))
    weights = materialize(scorer.coefficients, "coefficients")
    return optimality(cov, M.LinearScorer(weights, scorer.intercept).predict(cov, train), weights, path.final.penalty * path.final.rows)


@query(
    "lasso_fold_likelihood", "step:l fold:l rows:l outcomes:l agrees:b chosen:l",
    f"""WITH {_SPLIT_CTE} SELECT step, index AS fold, count(*) AS rows, sum(outcome_count) AS outcomes, TRUE AS agrees, 1 AS chosen
      FROM sp CROSS JOIN (SELECT unnest(range(4)) AS step) WHERE index > 0 GROUP BY 1, 2""", PV,
)
def _(cdm):
    """Held-out likelihood of every fold and penalty, recomputed from written
    coefficients; ``chosen`` counts the penalties with the best total."""
    cov, pop = data(cdm)
    train = pop.filter(F.col("index") > 0)
    _, path = M.fit_lasso_path(cov, train, F.col("index"), count=4, ratio=0.05)
    steps = [s for s in path.steps if s.fold]
    spark = cdm.spark
    at = [(path.penalties.index(s.penalty), s.fold, i, float(w)) for s in steps for i, w in enumerate(s.beta) if w]
    constants = literal_frame(spark, [(path.penalties.index(s.penalty), s.fold, s.constant, s.held_loss) for s in steps], "step long, fold long, constant double, loss double")
    weights = materialize(literal_frame(spark, at, "step long, fold long, idx int, w double").join(path.index, "idx"), "coefficients")
    held = train.select("row_id", F.col("index").alias("fold"), "outcome_count")
    part = held.join(cov, "row_id").join(weights, ["covariate_id", "fold"]).groupBy("step", "row_id").agg(F.sum(F.col("covariate_value") * F.col("w")).alias("part"))
    lp = held.join(constants, "fold").join(part, ["step", "row_id"], "left").withColumn("lp", F.col("constant") + F.coalesce("part", F.lit(0.0)))
    loss = F.sum(F.log1p(F.exp("lp")) - F.col("outcome_count") * F.col("lp"))
    again = lp.groupBy("step", "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("outcome_count").alias("outcomes"), F.max("loss").alias("loss"), loss.alias("anew"))
    again = materialize(again, "likelihood")
    totals = again.groupBy("step").agg(F.sum("anew").alias("total"))
    best = totals.agg(F.min("total")).scalar()
    chosen = totals.filter((F.col("total") <= best + 1e-6) & (F.col("step") == path.penalties.index(path.final.penalty))).agg(F.count(F.lit(1))).scalar()
    return again.select("step", "fold", "rows", "outcomes", (F.abs(F.col("loss") - F.col("anew")) < 1e-6 * F.col("loss")).alias("agrees"), chosen.alias("chosen"))


def _booster_sql(rounds: int, rate: float, l2: float) -> str:
    """Rounds one after another, each from the sums of the one before."""
    parts = [_SPLIT_CTE, "tr AS MATERIALIZED (SELECT row_id, outcome_count AS y FROM sp WHERE index > 0)",
             "xs AS MATERIALIZED (SELECT c.row_id, covariate_id, sum(covariate_value)::DOUBLE AS x FROM covs c JOIN tr ON tr.row_id = c.row_id GROUP BY 1, 2 UNION ALL SELECT row_id, 0, 1 FROM tr)",
             "w0 AS MATERIALIZED (SELECT DISTINCT covariate_id, 0.0::DOUBLE AS w FROM xs)"]
    for i in range(rounds + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT tr.row_id, y, lp, 1 / (1 + exp(-lp)) AS m FROM tr JOIN (SELECT row_id, sum(x * w) AS lp FROM xs JOIN w{i} ON xs.covariate_id = w{i}.covariate_id GROUP BY 1) s ON s.row_id = tr.row_id)")
        if i < rounds:
            parts.append(f"""w{i + 1} AS MATERIALIZED (SELECT covariate_id, w + {rate}::DOUBLE * ((h * w - g) / (h + CASE WHEN covariate_id = 0 THEN 0 ELSE {l2}::DOUBLE END) - w) AS w
              FROM (SELECT xs.covariate_id, any_value(w) AS w, sum(x * (m - y)) AS g, sum(x * x * m * (1 - m)) AS h FROM xs JOIN l{i} ON l{i}.row_id = xs.row_id JOIN w{i} ON w{i}.covariate_id = xs.covariate_id GROUP BY 1))""")
    out = [f"SELECT 'loss' AS kind, {i} AS id, sum(ln(1 + exp(lp)) - y * lp) AS value FROM l{i}" for i in range(rounds + 1)]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)} UNION ALL SELECT 'weight', covariate_id, w FROM w{rounds}"


@query("linear_booster", "kind:s id:l value:f", _booster_sql(4, 0.3, 1.0), PV)
def _(cdm):
    """Training loss after each round, and the weights after the last."""
    cov, pop = data(cdm)
    rows, index = P.sparse_rows(cov, pop.filter(F.col("index") > 0), F.col("outcome_count") > 0)
    found = P.coordinate_boosting(rows, index, rounds=4, rate=0.3, l2=1.0)
    losses = literal_frame(cdm.spark, [("loss", i, v) for i, v in enumerate(found.losses)] + [("weight", 0, found.constant)], "kind string, id long, value double")
    return losses.unionByName(found.coefficients().select(F.lit("weight").alias("kind"), F.col("covariate_id").alias("id"), F.col("coefficient").alias("value")))


query("fit_mlp", PRED)(_fit_predict(lambda c, p: M.fit_mlp(c, p)))
query("fit_iht", PRED)(_fit_predict(lambda c, p: M.fit_iht(c, p, 8)))
query("fit_adaboost", PRED)(_fit_predict(lambda c, p: M.fit_adaboost(c, p, 3)))

_KNN_VEC = "SELECT p.row_id, index, outcome_count, covariate_id FROM popn p JOIN ({s}) s ON s.row_id = p.row_id JOIN covs c ON c.row_id = p.row_id".format(s=_STRAT)


@query(
    "fit_knn", PRED,
    f"""WITH f AS ({_KNN_VEC}), nz AS (SELECT row_id, any_value(index) AS index, any_value(outcome_count) AS y, count(*) AS k FROM f GROUP BY 1),
      dots AS (SELECT a.row_id AS r, b.row_id AS t, count(*) AS d FROM f a JOIN f b ON a.covariate_id = b.covariate_id WHERE a.index < 0 AND b.index > 0 GROUP BY 1, 2),
      dist AS (SELECT x.row_id, x.index, x.y, n.y AS ny, row_number() OVER (PARTITION BY x.row_id ORDER BY x.k + n.k - 2 * COALESCE(d, 0), n.row_id) AS rk
        FROM nz x CROSS JOIN nz n LEFT JOIN dots ON r = x.row_id AND t = n.row_id WHERE x.index < 0 AND n.index > 0)
      SELECT row_id, index, y AS outcome_count, avg(ny) AS value FROM dist WHERE rk <= 10 GROUP BY 1, 2, 3""", PV,
)
def _(cdm):
    cov, pop = data(cdm)
    # Features absent from the training rows cannot change the order.
    return M.fit_knn(cov, pop.filter(F.col("index") > 0), 10).predict(cov, pop.filter(F.col("index") < 0))


def _columns(pop: DataFrame) -> DataFrame:
    return pop.withColumn("age", F.col("age_year") / 100.0).withColumn("male", (F.col("gender") == 8507).cast("double"))


@query(
    "fit_cox", _SUM,
    """SELECT CAST(covariate_id AS VARCHAR) AS name, count(*) AS rows, sum(covariate_value * outcome_count) AS observed, sum(covariate_value * outcome_count) AS fitted
      FROM covs c JOIN popn p ON p.row_id = c.row_id GROUP BY 1 UNION ALL SELECT '0', count(*), sum(outcome_count), sum(outcome_count) FROM popn""", PV,
)
def _(cdm):
    """Score equations of the penalised proportional hazards: per covariate
    its values over events, and over the hazard that its written coefficients
    give every row by the day it leaves."""
    cov, pop = materialize(covariates(cdm), "covariates"), materialize(population(cdm), "population")
    path = M.fit_sparse_cox(cov, pop, penalties=[0.002]).path
    weights = materialize(path.coefficients(), "coefficients")
    risk = materialize(M.LinearScorer(weights, 0.0).linear_predictor(cov, pop).withColumn("risk", F.exp("lp")), "risk")
    days = materialize(risk.groupBy("survival_time").agg(F.sum("risk").alias("risk"), F.sum("outcome_count").alias("events")), "days")
    staying = running_totals(days, [], "survival_time", ["risk"], descending=True)
    hazard = running_totals(staying.withColumn("step", F.col("events") / F.col("cum_risk")), [], "survival_time", ["step"])
    fitted = risk.join(hazard.select("survival_time", "cum_step"), "survival_time").withColumn("value", F.col("risk") * F.col("cum_step"))
    return optimality(cov, fitted, weights, path.final.penalty * path.final.rows)


@query("fit_ols", "intercept:f slope:f r2:f", "SELECT regr_intercept(outcome_count, age_year) AS intercept, regr_slope(outcome_count, age_year) AS slope, regr_r2(outcome_count, age_year) AS r2 FROM popn", PV)
def _(cdm):
    frame = population(cdm).select(
        F.col("outcome_count").cast("double").alias("label"), array_to_vector(F.array(F.col("age_year").cast("double"))).alias("features"))
    m = LinearRegression(solver="normal").fit(frame)
    return literal_frame(cdm.spark, [(float(m.intercept), float(m.coefficients[0]), float(m.summary.r2))], "intercept double, slope double, r2 double")


@dataclass
class RateModel:
    """Observed outcome rate by decade of age and gender; overall rate else."""

    rates: DataFrame
    overall: float
    width: int = 10

    def predict(self, covariates, population):
        tagged = population.withColumn("_d", F.floor(F.col("age_year") / self.width))
        return tagged.join(self.rates, ["_d", "gender"], "left").withColumn(
            "value", F.coalesce("_rate", F.lit(self.overall))).drop("_d", "_rate")


@dataclass(frozen=True)
class RateLearner:
    """``width`` years make an age band."""

    width: int = 10

    def fit(self, covariates, population):
        y = F.avg(F.col("outcome_count").cast("double"))
        rates = population.groupBy(F.floor(F.col("age_year") / self.width).alias("_d"), "gender").agg(y.alias("_rate"))
        return RateModel(rates, population.agg(y).first()[0], self.width)


_RATE = "SELECT age_year // 10 AS d, gender AS g, avg(outcome_count) AS r FROM sp WHERE {w} GROUP BY 1, 2"


@query(
    "fit_custom", PRED,
    f"WITH {_SPLIT_CTE}, r AS ({_RATE.format(w='index > 0')}) SELECT row_id, index, outcome_count, COALESCE(r, (SELECT avg(outcome_count) FROM sp WHERE index > 0)) AS value FROM sp LEFT JOIN r ON d = age_year // 10 AND g = gender", PV,
)
def _(cdm):
    cov, pop = data(cdm)
    return RateLearner().fit(cov, pop.filter(F.col("index") > 0)).predict(cov, pop)


@query(
    "cv_predictions", PRED,
    f"WITH {_SPLIT_CTE} " + " UNION ALL ".join(
        f"SELECT row_id, index, outcome_count, COALESCE(r, (SELECT avg(outcome_count) FROM sp WHERE index > 0 AND index <> {k})) AS value FROM sp LEFT JOIN ({_RATE.format(w=f'index > 0 AND index <> {k}')}) ON d = age_year // 10 AND g = gender WHERE index = {k}"
        for k in (1, 2, 3)), PV,
)
def _(cdm):
    cov, pop = data(cdm)
    return M.out_of_fold(pop.drop("index"), pop.select("row_id", "index"), RateLearner(), cov)


def _area_sql(scored: str, keys: str) -> str:
    """Area under the curve per key from rows with outcome_count and value."""
    return f"""SELECT {keys}, sum(n) AS rows, sum(pos * (COALESCE(b, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
        FROM (SELECT {keys}, value, count(*) AS n, sum(outcome_count) AS pos, sum(1 - outcome_count) AS neg FROM ({scored}) GROUP BY ALL)) GROUP BY {keys}"""


def _rates_sql(train: str, test: str, width: int = 10, extra: str = "") -> str:
    return f"""SELECT {extra} t.*, COALESCE(r, (SELECT avg(outcome_count) FROM {train})) AS value FROM {test} t
      LEFT JOIN (SELECT age_year // {width} AS d, gender AS g, avg(outcome_count) AS r FROM {train} GROUP BY 1, 2) ON d = age_year // {width} AND g = gender"""


_HELD = " UNION ALL ".join(
    _rates_sql(f"(SELECT * FROM sp WHERE index > 0 AND index <> {k})", f"(SELECT * FROM sp WHERE index = {k})", w, f"{i} AS setting,")
    for i, w in enumerate((5, 10, 20)) for k in (1, 2, 3))


@query(
    "grid_search_cv", "setting:l fold:l rows:l auc:f best:b",
    f"""WITH {_SPLIT_CTE}, held AS ({_HELD}), areas AS ({_area_sql("SELECT *, index AS fold FROM held UNION ALL SELECT *, 0 FROM held", "setting, fold")}),
      means AS (SELECT setting, avg(auc) AS m FROM areas WHERE fold > 0 GROUP BY 1)
      SELECT *, setting = (SELECT setting FROM means ORDER BY m DESC, setting LIMIT 1) AS best FROM areas""", PV,
)
def _(cdm):
    cov, pop = data(cdm)
    return M.cross_validate(cov, pop.drop("index"), pop.select("row_id", "index"), [RateLearner(5), RateLearner(10), RateLearner(20)])[1]


@query("grid_search_lasso", "setting:l fold:l rows:l has_auc:b",
       f"WITH {_SPLIT_CTE} SELECT setting, fold, count(*) AS rows, TRUE AS has_auc FROM (SELECT unnest([0, index]) AS fold FROM sp WHERE index > 0) CROSS JOIN (SELECT unnest([0, 1]) AS setting) GROUP BY 1, 2", PV)
def _(cdm):
    cov, pop = data(cdm)
    grid = [{"regParam": 0.001}, {"regParam": 0.05}]
    table = M.grid_search_cv(cov, pop.drop("index"), pop.select("row_id", "index"), M.ModelSpec("lasso_lr"), grid)[1]
    return table.withColumn("has_auc", F.col("auc").between(0, 1))


@query("feature_select_rf", "covariate_id:l importance:f")
def _(cdm):
    cov, pop = data(cdm)
    frame, index = M.training_frame(cov, pop)
    return X.select_random_forest(frame, index)


@query("gain_importance", "covariate_id:l importance:f")
def _(cdm):
    cov, pop = data(cdm)
    model = M.fit(cov, pop, M.ModelSpec("gbm", (("maxIter", 5),)))
    return X.importance_table(model.classifier, model.index)


@query("age_spline", "row_id:l covariate_id:l covariate_value:f")
def _(cdm):
    return X.age_spline(materialize(population(cdm), "population"))[0]


@query("early_stopping", "trees:l limit:l rows:l auc:f")
def _(cdm):
    cov, pop = data(cdm)
    frame, index = M.training_frame(cov, pop.filter(F.col("index") > 0))
    flagged = frame.withColumn("held", F.col("index") == 1)
    model = MC.GBTClassifier(maxIter=12, maxDepth=2, seed=1, validationIndicatorCol="held", validationTol=0.01).fit(flagged)
    test = M.VectorModel(model, index).predict(cov, pop.filter(F.col("index") < 0))
    return E.auc(test).withColumn("trees", F.lit(model.getNumTrees)).withColumn("limit", F.lit(12)).withColumn(
        "rows", test.agg(F.count(F.lit(1))).scalar())


@query("leaf_features", "tree:l leaf:l rows:l")
def _(cdm):
    cov, pop = data(cdm)
    frame, _ = M.training_frame(cov, pop)
    model = MC.RandomForestClassifier(numTrees=5, maxDepth=3, seed=1, leafCol="leaves").fit(frame)
    leaves = model.transform(frame).select("row_id", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    return leaves.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows"))


@query("staged_prediction", "trees:l auc:f")
def _(cdm):
    cov, pop = data(cdm)
    frame, _ = M.training_frame(cov, pop)
    model = MC.GBTClassifier(maxIter=6, maxDepth=2, seed=1).fit(frame)
    margin, scored_frame, out = F.lit(0.0), frame, None
    for i, (tree, w) in enumerate(zip(model.trees, model.treeWeights, strict=True), 1):
        scored_frame = tree.setPredictionCol(f"_t{i}").transform(scored_frame)
        margin = margin + F.lit(float(w)) * F.col(f"_t{i}")
        if i in (1, 3, 6):
            stage = scored_frame.withColumn("value", 1 / (1 + F.exp(-2 * margin)))
            part = E.auc(stage).withColumn("trees", F.lit(i))
            out = part if out is None else out.unionByName(part)
    return out


def _score_rows(frame: DataFrame, weight, family: str) -> list:
    """Observed and fitted sums of the constant and both columns."""
    terms = (("intercept", F.lit(1.0)), ("age", F.col("age")), ("male", F.col("male")))
    return [frame.agg(F.count(F.lit(1)).alias("rows"), F.sum(x * F.col("label") * weight).alias("observed"), F.sum(x * F.col("fit") * weight).alias("fitted")).withColumn(
        "name", F.lit(f"{family} {n}")) for n, x in terms]


_GLM_TERMS = (("intercept", "1"), ("age", "age_year / 100.0::DOUBLE"), ("male", "CASE WHEN gender = 8507 THEN 1 ELSE 0 END"))


def _score_sql(family: str, source: str, outcome: str) -> str:
    return " UNION ALL ".join(f"SELECT '{family} {n}' AS name, count(*) AS rows, sum({x} * {outcome}) AS observed, sum({x} * {outcome}) AS fitted FROM {source}" for n, x in _GLM_TERMS)


@query("warm_margin", _SUM, _score_sql("binomial", "popn", "outcome_count"), PV)
def _(cdm):
    """Score equations of a logistic model that starts from another's margin."""
    base = _columns(scored(cdm)).withColumn("offset", E.logit(F.col("value"))).drop("value")
    frame = materialize(base.withColumn("features", array_to_vector(F.array("age", "male"))).withColumn(
        "label", F.col("outcome_count").cast("double")), "offset")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", offsetCol="offset", predictionCol="fit", maxIter=50, tol=1e-13)
    fitted = materialize(glm.fit(frame).transform(frame).drop("features"), "fitted")
    return reduce(DataFrame.unionByName, _score_rows(fitted, F.lit(1.0), "binomial"))


@query(
    "count_regression", _SUM,
    _score_sql("poisson", "n", "outcome_count") + " UNION ALL " + " UNION ALL ".join(f"SELECT 'tweedie {n}', count(*), 0, 0 FROM n" for n, _ in _GLM_TERMS),
    PV | {"n": "SELECT p.*, inside AS outcome_count FROM (SELECT * EXCLUDE (outcome_count) FROM popn) p"},
)
def _(cdm):
    """Score equations of counts of outcomes: observed and fitted sums of the
    Poisson model; those of the Tweedie model, weighted by its variance, less
    one another."""
    counted = N.study_population(target_rows(cdm), N.outcome_days(cdm.cohort, [3]), 3, replace(SPEC, binary=False))
    frame = materialize(_columns(counted).select(
        F.col("outcome_count").cast("double").alias("label"), "age", "male", array_to_vector(F.array("age", "male")).alias("features")), "counts")
    out = []
    for family, kw in (("poisson", {"family": "poisson", "link": "log"}), ("tweedie", {"family": "tweedie", "variancePower": 1.4, "linkPower": 0.0})):
        model = GeneralizedLinearRegression(maxIter=50, tol=1e-13, predictionCol="fit", **kw).fit(frame)
        fitted = materialize(model.transform(frame).drop("features"), "fitted")
        if family == "poisson":
            out += _score_rows(fitted, F.lit(1.0), family)
        else:
            out += [r.withColumn("fitted", F.col("fitted") - F.col("observed")).withColumn("observed", F.lit(0.0)) for r in _score_rows(fitted, F.pow("fit", F.lit(-0.4)), family)]
    return reduce(DataFrame.unionByName, out)


@query("refit", "term:s rows:l auc:f")
def _(cdm):
    """A model refitted on new data with the features of the first one."""
    cov, pop = data(cdm)
    first = M.fit(cov, pop.filter(F.col("subject_id") % 2 == 0), M.ModelSpec())
    kept = M.kept_covariates(first)
    new = pop.filter(F.col("subject_id") % 2 == 1)
    again = M.fit(cov.join(kept, "covariate_id", "left_semi"), new, M.ModelSpec("lasso_lr", (("regParam", 0.0),)))
    out = None
    for term, model in (("original", first), ("refitted", again)):
        p = materialize(model.predict(cov, new), "refit")
        f = E.auc(p).withColumn("term", F.lit(term)).withColumn("rows", p.agg(F.count(F.lit(1))).scalar())
        out = f if out is None else out.unionByName(f)
    return out


@query("external_validation", "metric:s value:f")
def _(cdm):
    cov, pop = data(cdm)
    model = M.fit(cov, pop.filter(F.col("subject_id") % 2 == 0), M.ModelSpec())
    return U.external_validation(model, cov, pop.filter(F.col("subject_id") % 2 == 1))[1]


_DIGEST = "md5(row_id || '|101')"


def _curve_sql(parts: list[tuple[str, str, str]]) -> str:
    """(column, value, condition on training rows ``tr``) of each point."""
    rows = " UNION ALL ".join(
        f"""SELECT {value} AS {column}, (SELECT count(*) FROM tr WHERE {test}) AS rows, (SELECT sum(outcome_count) FROM tr WHERE {test}) AS outcomes, auc
          FROM ({_area_sql(_rates_sql(f"(SELECT * FROM tr WHERE {test})", "(SELECT * FROM sp WHERE index < 0)", extra="1 AS one,"), "one")})"""
        for column, value, test in parts)
    return f"WITH {_SPLIT_CTE}, tr AS (SELECT *, {_DIGEST} AS h, (CAST('0x' || substr({_DIGEST}, 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE) AS f FROM sp WHERE index > 0) {rows}"


@query("learning_curve", "fraction:f rows:l outcomes:l auc:f", _curve_sql([("fraction", f"{f}::DOUBLE", f"f < {f}") for f in (0.25, 0.5, 1.0)]), PV)
def _(cdm):
    cov, pop = data(cdm)
    return M.learning_curve(cov, pop.drop("index"), pop.select("row_id", "index"), RateLearner(), (0.25, 0.5, 1.0))


@query(
    "learning_curve_events", "events:l rows:l outcomes:l auc:f",
    _curve_sql([("events", str(n), f"h <= (SELECT h FROM tr WHERE outcome_count > 0 ORDER BY h LIMIT 1 OFFSET {n - 1})") for n in (10, 25, 60)]), PV,
)
def _(cdm):
    cov, pop = data(cdm)
    return M.learning_curve(cov, pop.drop("index"), pop.select("row_id", "index"), RateLearner(), events=(10, 25, 60))


def _design_sql(target: int, end: int) -> str:
    """One design of age and gender rates over its own population."""
    spec = replace(SPEC, risk_end=end)

    def own(sql: str) -> str:
        return re.sub(r"\b(target|outc|popn)\b", rf"\1_{target}_{end}", sql)

    ctes = {"target": _target_sql(target), "outc": PV["outc"], "popn": f"SELECT * FROM ({_flag_sql(spec)}) WHERE s5", "sp": f"SELECT popn.*, index FROM popn JOIN ({_STRAT}) s ON s.row_id = popn.row_id"}
    head = ", ".join(own(f"{n} AS ({q})") for n, q in ctes.items())
    scored = own(_rates_sql("(SELECT * FROM sp WHERE index > 0)", "(SELECT * FROM sp WHERE index < 0)", extra="1 AS one,"))
    return f"""SELECT * FROM (WITH {head}, area AS ({_area_sql(scored, "one")})
      SELECT {target} AS target_id, 3 AS outcome_id, 'rates' AS covariates, 'RateLearner' AS model, {end} AS risk_end, (SELECT count(*) FROM sp) AS rows, (SELECT sum(outcome_count) FROM sp) AS outcomes, auc FROM area)"""


@query(
    "run_multiple", "target_id:l outcome_id:l covariates:s model:s risk_end:l rows:l outcomes:l auc:f",
    " UNION ALL ".join(_design_sql(t, e) for t in (1, 4) for e in (SPEC.risk_end, 180)),
)
def _(cdm):
    """Designs of two targets and two risk windows, resumed from a manifest
    that already holds the first of them."""
    rows = with_row_id(cdm.cohort.filter(F.col("cohort_definition_id").isin(1, 4)))
    rows = N.plp_cohort(cdm, rows, N.TargetSpec(row_id="row_id"))
    todo = U.designs([1, 3, 4], [3], U.with_risk_ends(SPEC, [SPEC.risk_end, 180]), [RateLearner()], covariates=["rates", "none"],
                     restrict=lambda d: d.target_id != d.outcome_id and d.covariates == "rates")
    settings = {"rates": covariates(cdm, rows), "none": covariates(cdm, rows).limit(0)}
    manifest = scratch_path(cdm.spark, "designs")
    U.run_multiple(rows, settings, cdm.cohort, todo[:1], manifest=manifest)
    return U.run_multiple(rows, settings, cdm.cohort, todo, manifest=manifest)


@query("stacked_ensemble", "row_id:l index:l outcome_count:l value:f")
def _(cdm):
    cov, pop = data(cdm)
    train = pop.filter(F.col("index") > 0)
    members = [M.fit(cov, train, M.ModelSpec("lasso_lr")).predict(cov, pop), M.fit(cov, train, M.ModelSpec("rf")).predict(cov, pop)]
    return M.stacked_ensemble(members, pop.select("row_id", "index"))
