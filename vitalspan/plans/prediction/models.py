"""Learners on sparse covariates. Training frames are written once and
re-read by every iteration."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.ranks import hash_fraction, hash_order, row_numbers, running_totals
from vitalspan.plans.prediction import evaluate as E
from vitalspan.plans.prediction.features import feature_index, to_vectors
from vitalspan.plans.prediction.neighbours import fit_knn as fit_knn
from vitalspan.plans.prediction.sparse import PathResult, coordinate_boosting, lasso_path, sparse_rows
from vitalspan.session import concurrently, literal_frame, materialize


class Model(Protocol):
    """What the pipeline needs from a fitted model."""

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame: ...


class Learner(Protocol):
    """User-defined learners implement this."""

    def fit(self, covariates: DataFrame, population: DataFrame) -> Model: ...


# --- frames ---------------------------------------------------------------------
def design(covariates: DataFrame, population: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Population rows with a feature vector; rows without covariates get zeros."""
    index = feature_index(covariates) if index is None else index
    vectors, index = to_vectors(covariates.join(population.select("row_id"), "row_id", "left_semi"), index)
    zero = array_to_vector(F.array_repeat(F.lit(0.0), index.count()))
    label = (F.col("outcome_count") > 0).cast("double").alias("label")
    frame = population.select("*", label).join(vectors, "row_id", "left")
    return frame.withColumn("features", F.coalesce("features", zero)), index


def training_frame(covariates: DataFrame, population: DataFrame) -> tuple[DataFrame, DataFrame]:
    index = materialize(feature_index(covariates.join(population.select("row_id"), "row_id", "left_semi")), "features")
    frame, _ = design(covariates, population, index)
    return materialize(frame, "train"), index


def positive_probability(scored: DataFrame) -> DataFrame:
    if "probability" in scored.columns:
        value = vector_to_array("probability")[1]
    else:  # margin-only classifiers
        value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.withColumn("value", value)


@dataclass
class VectorModel:
    """A Spark ML classifier with its feature layout."""

    classifier: object
    index: DataFrame
    extra: dict = field(default_factory=dict)

    def score(self, frame: DataFrame) -> DataFrame:
        drop = {"features", "label", "rawPrediction", "probability", "prediction"}
        out = positive_probability(self.classifier.transform(frame))
        return out.select(*[c for c in out.columns if c not in drop])

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        frame, _ = design(covariates, population, self.index)
        return self.score(frame)


@dataclass
class LinearScorer:
    """Predicts from a (covariate_id, coefficient) table without vectors: one
    join on the covariate id and one sum per row."""

    coefficients: DataFrame
    intercept: float

    def linear_predictor(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        parts = covariates.join(self.coefficients, "covariate_id").groupBy("row_id").agg(
            F.sum(F.col("covariate_value") * F.col("coefficient")).alias("_lp"))
        return population.join(parts, "row_id", "left").withColumn(
            "lp", F.lit(float(self.intercept)) + F.coalesce(F.col("_lp"), F.lit(0.0))).drop("_lp")

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        return self.linear_predictor(covariates, population).withColumn("value", 1 / (1 + F.exp(-F.col("lp")))).drop("lp")


def linear_scorer(model, index: DataFrame) -> LinearScorer:
    """Coefficients of a fitted logistic regression as a table."""
    beta = model.coefficients
    table = literal_frame(index.sparkSession, [(int(i), float(v)) for i, v in enumerate(beta.toArray()) if v], "idx int, coefficient double")
    return LinearScorer(index.join(table, "idx").select("covariate_id", "coefficient"), float(model.intercept))


def fit_lasso_path(covariates: DataFrame, population: DataFrame, fold: Column | None = None, **path) -> tuple[LinearScorer, PathResult]:
    """Lasso logistic regression whose penalty is chosen from the data by
    held-out likelihood over the folds (1, 2, ...)."""
    rows, index = sparse_rows(covariates, population, F.col("outcome_count") > 0, fold)
    found = lasso_path(rows, index, "logistic", **path)
    return LinearScorer(found.coefficients(), found.final.constant), found


def constant_scorer(frame: DataFrame, index: DataFrame) -> LinearScorer:
    """What can be learned without covariates: the share of outcomes."""
    rows, cases = frame.agg(F.count("label"), F.sum("label")).first()
    if not rows:
        raise ValueError("no rows to learn from")
    odds = math.log(cases / (rows - cases)) if 0 < cases < rows else math.copysign(math.inf, cases - rows / 2)
    return LinearScorer(index.select("covariate_id", F.lit(0.0).alias("coefficient")), odds)


def kept_covariates(model: VectorModel | LinearScorer) -> DataFrame:
    """``covariate_id`` of the covariates a linear model has not dropped."""
    scorer = model if isinstance(model, LinearScorer) else linear_scorer(model.classifier, model.index)
    return scorer.coefficients.select("covariate_id")


# --- learners -------------------------------------------------------------------
CLASSIFIERS: dict[str, Callable[..., object]] = {
    "lasso_lr": lambda **p: C.LogisticRegression(**({"elasticNetParam": 1.0, "regParam": 0.01, "maxIter": 50} | p)),
    "gbm": lambda **p: C.GBTClassifier(**({"maxIter": 10, "maxDepth": 3, "stepSize": 0.1, "seed": 1} | p)),
    "rf": lambda **p: C.RandomForestClassifier(**({"numTrees": 20, "maxDepth": 4, "seed": 1} | p)),
    "dt": lambda **p: C.DecisionTreeClassifier(**({"maxDepth": 4, "seed": 1} | p)),
    "nb": lambda **p: C.NaiveBayes(**p),
    "svm": lambda **p: C.LinearSVC(**({"maxIter": 20, "regParam": 0.01} | p)),
}


@dataclass(frozen=True)
class ModelSpec:
    kind: str = "lasso_lr"
    params: tuple[tuple[str, object], ...] = ()

    def estimator(self, **override):
        return CLASSIFIERS[self.kind](**(dict(self.params) | override))

    def fit(self, covariates: DataFrame, population: DataFrame) -> Model:
        if self.kind == "linear_booster":
            return fit_linear_booster(covariates, population, **dict(self.params))
        return fit(covariates, population, self)


def fit(covariates: DataFrame, population: DataFrame, spec: ModelSpec) -> VectorModel | LinearScorer:
    frame, index = training_frame(covariates, population)
    if index.isEmpty():
        return constant_scorer(frame, index)
    return VectorModel(spec.estimator().fit(frame), index)


def fit_linear_booster(covariates: DataFrame, population: DataFrame, **settings) -> LinearScorer:
    """Boosted coordinates; see ``coordinate_boosting`` for the settings."""
    rows, index = sparse_rows(covariates, population, F.col("outcome_count") > 0)
    found = coordinate_boosting(rows, index, **settings)
    return LinearScorer(found.coefficients(), found.constant)


def fit_mlp(covariates: DataFrame, population: DataFrame, hidden: Sequence[int] = (8,), seed: int = 1, iterations: int = 30) -> VectorModel:
    frame, index = training_frame(covariates, population)
    layers = [index.count(), *hidden, 2]
    return VectorModel(C.MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=iterations).fit(frame), index)


def fit_iht(covariates: DataFrame, population: DataFrame, k: int = 10, rounds: int = 3) -> LinearScorer:
    """Keep the k largest coefficients, refit on them, until the set is stable.

    A penalty of the first fit that drops every covariate is lowered.
    """
    kept, support = covariates, None
    for i in range(rounds):
        frame, index = training_frame(kept, population)
        if index.isEmpty():
            return constant_scorer(frame, index)
        for reg in (0.005, 0.0005, 0.0) if i == 0 else (0.0,):
            model = C.LogisticRegression(elasticNetParam=1.0, regParam=reg, maxIter=50).fit(frame)
            if model.coefficients.numNonzeros():
                break
        scorer = linear_scorer(model, index)
        top = scorer.coefficients.orderBy(F.abs("coefficient").desc(), "covariate_id").limit(k)
        ids = frozenset(r[0] for r in top.select("covariate_id").collect())
        if ids == support or not ids:
            return scorer
        support = ids
        kept = covariates.filter(F.col("covariate_id").isin(sorted(ids)))
    return scorer


@dataclass
class AdaBoostModel:
    members: list[tuple[float, object]]
    index: DataFrame

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        frame, _ = design(covariates, population, self.index)
        votes, total = F.lit(0.0), sum(a for a, _ in self.members)
        keep = [c for c in frame.columns if c not in ("features", "label")]
        for i, (a, tree) in enumerate(self.members):
            frame = tree.setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}").transform(frame)
            votes = votes + F.lit(a) * F.col(f"_p{i}")
        return frame.select(*keep, (votes / F.lit(total)).alias("value"))


def fit_adaboost(covariates: DataFrame, population: DataFrame, rounds: int = 3, learning_rate: float = 1.0, depth: int = 1) -> AdaBoostModel:
    """Weighted stumps; each round's weights are written before the next."""
    frame, index = training_frame(covariates, population)
    weighted = frame.withColumn("weight", F.lit(1.0))
    members: list[tuple[float, object]] = []
    for i in range(rounds):
        tree = C.DecisionTreeClassifier(maxDepth=depth, weightCol="weight", seed=i).fit(weighted)
        miss = (F.col("prediction") != F.col("label")).cast("double")
        hit = tree.transform(weighted).withColumn("_miss", miss)
        wrong, total = hit.agg(F.sum(F.col("weight") * F.col("_miss")), F.sum("weight")).first()
        error = min(max(wrong / total, 1e-10), 1 - 1e-10)
        if error >= 0.5:
            members = members or [(1.0, tree)]
            break
        alpha = learning_rate * math.log((1 - error) / error)
        members.append((alpha, tree))
        boosted = hit.withColumn("weight", F.col("weight") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(total))
        weighted = materialize(boosted.select(*frame.columns, "weight"), "boost")
    return AdaBoostModel(members, index)


# --- time to event -----------------------------------------------------------------
@dataclass
class CoxModel:
    """Relative hazards from sparse covariates."""

    path: PathResult

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        lp = LinearScorer(self.path.coefficients(), 0.0).linear_predictor(covariates, population)
        return lp.withColumn("value", F.exp("lp")).drop("lp")


def fit_sparse_cox(covariates: DataFrame, population: DataFrame, time: str = "survival_time", fold: Column | None = None, **path) -> CoxModel:
    """Proportional hazards with an L1 penalty over any number of covariates;
    with folds the penalty is chosen by held-out partial likelihood."""
    rows, index = sparse_rows(covariates, population, F.col("outcome_count") > 0, fold, F.col(time))
    return CoxModel(lasso_path(rows, index, "cox", **path))


@dataclass
class ColumnCoxModel:
    columns: list[str]
    beta: list[float]

    def predict(self, frame: DataFrame) -> DataFrame:
        lp = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for w, c in zip(self.beta, self.columns, strict=True)])
        return frame.withColumn("value", F.exp(lp))


def fit_cox(frame: DataFrame, columns: list[str], time: str, event: str, l1: float = 0.0) -> ColumnCoxModel:
    """The same model on a few named columns of a frame with row ids."""
    values = F.array(*[F.struct(F.lit(i).cast("long").alias("covariate_id"), F.col(c).cast("double").alias("covariate_value")) for i, c in enumerate(columns)])
    covariates = frame.select("row_id", F.explode(values).alias("_e")).select("row_id", "_e.*")
    rows, index = sparse_rows(covariates, frame, F.col(event), None, F.col(time))
    found = lasso_path(rows, index, "cox", penalties=[l1])
    beta = {r.covariate_id: r.coefficient for r in found.coefficients().collect()}
    return ColumnCoxModel(columns, [beta.get(i, 0.0) for i in range(len(columns))])


# --- selection and curves -------------------------------------------------------------
@dataclass(frozen=True)
class FrameLearner:
    """An estimator on feature vectors that were written once for all fits."""

    frame: DataFrame
    index: DataFrame
    estimator: object

    def fit(self, covariates: DataFrame, population: DataFrame) -> FrameModel:
        train = materialize(self.frame.join(population.select("row_id"), "row_id", "left_semi"), "part")
        return FrameModel(VectorModel(self.estimator.fit(train), self.index), self.frame)


@dataclass(frozen=True)
class FrameModel:
    model: VectorModel
    frame: DataFrame

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        return self.model.score(self.frame.join(population.select("row_id"), "row_id", "left_semi"))


def cross_validate(
    covariates: DataFrame, population: DataFrame, folds: DataFrame, learners: Sequence[Learner], workers: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Every learner on every fold, side by side.

    Returns the written held-out predictions (``setting, index, row_id,
    outcome_count, value``) and ``setting, fold, rows, auc, best``: all areas
    come from one grouped pass; fold 0 is over all held-out predictions; best
    has the largest mean over the folds, of equals the first.
    """
    spark = population.sparkSession
    labelled = materialize(population.join(folds.filter(F.col("index") > 0), "row_id"), "labelled")
    ids = [r[0] for r in labelled.select("index").distinct().orderBy("index").collect()]

    def job(s: int, fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            model = learners[s].fit(covariates, labelled.filter(F.col("index") != fold))
            held = model.predict(covariates, labelled.filter(F.col("index") == fold))
            return materialize(held.select(F.lit(s).cast("long").alias("setting"), "index", "row_id", "outcome_count", "value"), "heldout")
        return run

    scored = reduce(DataFrame.unionByName, concurrently(spark, [job(s, f) for s in range(len(learners)) for f in ids], workers))
    both = scored.select("*", F.explode(F.array(F.lit(0).cast("long"), F.col("index").cast("long"))).alias("fold"))
    sizes = both.groupBy("setting", "fold").agg(F.count(F.lit(1)).alias("rows"))
    table = materialize(sizes.join(E.auc(both, ["setting", "fold"]), ["setting", "fold"]), "areas")
    mean = table.filter(F.col("fold") > 0).groupBy("setting").agg(F.avg(F.coalesce("auc", F.lit(0.0))).alias("mean")).collect()
    best = min(mean, key=lambda r: (-r["mean"], r["setting"]))["setting"]
    return scored, table.withColumn("best", F.col("setting") == best)


def grid_search_cv(
    covariates: DataFrame, population: DataFrame, folds: DataFrame, spec: ModelSpec, grid: Sequence[dict], workers: int = 4,
) -> tuple[VectorModel, DataFrame]:
    """Cross-validation of every setting over one written frame; the best is
    refitted on all rows. Returns the model and the table of areas."""
    frame, index = training_frame(covariates, population.join(folds.filter(F.col("index") > 0), "row_id"))
    learners = [FrameLearner(frame, index, spec.estimator(**params)) for params in grid]
    _, table = cross_validate(covariates, population, folds, learners, workers)
    best = table.filter("best").first()["setting"]
    return VectorModel(spec.estimator(**grid[best]).fit(frame), index, {"setting": best}), table


def out_of_fold(population: DataFrame, folds: DataFrame, learner: Learner, covariates: DataFrame) -> DataFrame:
    """Predictions for each fold from a model of the other folds."""
    labelled = population.join(folds.filter(F.col("index") > 0), "row_id")
    ids = [r[0] for r in labelled.select("index").distinct().orderBy("index").collect()]
    parts = []
    for fold in ids:
        model = learner.fit(covariates, labelled.filter(F.col("index") != fold))
        parts.append(model.predict(covariates, labelled.filter(F.col("index") == fold)))
    return reduce(DataFrame.unionByName, parts)


def event_prefixes(train: DataFrame, events: Sequence[int], seed: int) -> list[tuple[int, str]]:
    """For each number of outcomes the digest up to which rows, in hash order,
    hold exactly as many. Numbers beyond the last outcome are left out."""
    hits = train.filter(F.col("outcome_count") > 0).select(hash_order("row_id", seed=seed).alias("_h"))
    ranked = row_numbers(hits, [], ["_h"])
    return [(r.rn, r["_h"]) for r in ranked.filter(F.col("rn").isin([int(e) for e in events])).orderBy("rn").collect()]


def learning_curve(
    covariates: DataFrame, population: DataFrame, split: DataFrame, learner: Learner, fractions: Sequence[float] = (), events: Sequence[int] = (),
    seed: int = 101, workers: int = 4,
) -> DataFrame:
    """AUC on a fixed test set for nested parts of the training rows, by their
    share (``fractions``) or by their number of outcomes (``events``).

    Parts are prefixes in hash order, so a smaller one lies within a larger
    one; fits run side by side. ``events`` in the result is the number asked
    for, null for shares. The seed must differ from the split's, which also
    ranks rows by hash.
    """
    spark = population.sparkSession
    labelled = materialize(population.join(split, "row_id"), "labelled")
    train, test = labelled.filter(F.col("index") > 0), labelled.filter(F.col("index") < 0)
    parts = [(float(f), None, train.filter(hash_fraction("row_id", seed=seed) < f)) for f in fractions]
    parts += [(None, n, train.filter(hash_order("row_id", seed=seed) <= cut)) for n, cut in event_prefixes(train, events, seed)]

    def job(share: float | None, wanted: int | None, part: DataFrame) -> Callable[[], tuple]:
        def run() -> tuple:
            n, hits = part.agg(F.count(F.lit(1)), F.sum((F.col("outcome_count") > 0).cast("long"))).first()
            area = E.auc(learner.fit(covariates, part).predict(covariates, test)).first()["auc"]
            return share, wanted, int(n), int(hits or 0), None if area is None else float(area)
        return run

    rows = concurrently(spark, [job(*p) for p in parts], workers)
    return literal_frame(spark, rows, "fraction double, events long, rows long, outcomes long, auc double")


def permutation_importance(
    scorer: LinearScorer, covariates: DataFrame, population: DataFrame, covariate_ids: Sequence[int], seed: int = 0,
) -> DataFrame:
    """Drop in AUC when one covariate's values are shuffled over the rows.

    Row i receives the value of the row whose hash rank is i's id rank. Only
    rows whose value changes count: the area changes by their ranks, old and
    new, among all scores, and by the order of moved rows among themselves.
    The base distribution is sorted once for all covariates.
    """
    rows = materialize(population.select("row_id", "outcome_count"), "rows")
    base = scorer.linear_predictor(covariates, rows).withColumn("y", (F.col("outcome_count") > 0).cast("long"))
    base = materialize(base.select("row_id", "y", "lp"), "base")
    receiver = row_numbers(rows.select("row_id"), [], ["row_id"])
    hashed = rows.select(F.col("row_id").alias("donor"), hash_order("row_id", seed=seed).alias("_h"))
    donor = row_numbers(hashed, [], ["_h"]).select("donor", "rn")
    pairs = receiver.join(donor, "rn").select("row_id", "donor")
    values = covariates.filter(F.col("covariate_id").isin(list(covariate_ids))).join(scorer.coefficients, "covariate_id").select(
        "row_id", "covariate_id", (F.col("covariate_value") * F.col("coefficient")).alias("part"))
    values = materialize(values, "parts")
    own = values.join(rows.select("row_id"), "row_id").select("row_id", "covariate_id", (-F.col("part")).alias("part"))
    given = values.withColumnRenamed("row_id", "donor").join(pairs, "donor").select("row_id", "covariate_id", "part")
    delta = own.unionByName(given).groupBy("row_id", "covariate_id").agg(F.sum("part").alias("delta")).filter(F.abs("delta") > 1e-12)
    moved = base.join(delta, "row_id")

    moved = moved.select("covariate_id", "y", F.round("lp", 9).alias("old"), F.round(F.col("lp") + F.col("delta"), 9).alias("new"))
    moved = materialize(moved, "moved")
    grouped = base.groupBy(F.round("lp", 9).alias("value")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    zero = F.lit(0).cast("long")
    points = grouped.unionByName(moved.select(F.col("new").alias("value"), zero.alias("pos"), zero.alias("neg")))
    points = points.groupBy("value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = (grouped.agg(F.sum(c)).scalar() for c in ("pos", "neg"))
    # negatives below a score and positives above it, in the one base distribution
    ranked = running_totals(points, [], "value", ["pos", "neg"]).select(
        "value", (F.col("cum_neg") - F.col("neg") / 2.0).alias("below"), (p - F.col("cum_pos") + F.col("pos") / 2.0).alias("above"))
    sides = F.array(F.struct(F.col("new").alias("value"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("value"), F.lit(-1).alias("sign")))
    change = moved.select("covariate_id", "y", F.explode(sides).alias("_s")).groupBy("covariate_id", F.col("_s.value").alias("value")).agg(
        F.sum(F.col("y") * F.col("_s.sign")).alias("dp"), F.sum((1 - F.col("y")) * F.col("_s.sign")).alias("dn"))
    # pairs of two moved rows count once by their own order
    own_order = F.col("cum_dn") - F.col("dn") / 2.0
    gain = F.col("dp") * F.col("below") + F.col("dn") * F.col("above") + F.col("dp") * own_order
    change = running_totals(change, ["covariate_id"], "value", ["dn"]).join(ranked, "value")
    per_id = change.groupBy("covariate_id").agg((-F.sum(gain) / (p * n)).alias("_drop"))
    wanted = literal_frame(rows.sparkSession, [(int(i),) for i in dict.fromkeys(covariate_ids)], "covariate_id long")
    return wanted.join(per_id, "covariate_id", "left").select("covariate_id", F.coalesce("_drop", F.lit(0.0)).alias("importance"))


def stacked_ensemble(predictions: Sequence[DataFrame], split: DataFrame) -> DataFrame:
    """Logistic regression over the members' logits, fitted on the training rows."""
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = predictions[0].select("row_id", "outcome_count", E.logit(clip(F.col("value"))).alias("m0"))
    for i, p in enumerate(predictions[1:], 1):
        joined = joined.join(p.select("row_id", E.logit(clip(F.col("value"))).alias(f"m{i}")), "row_id")
    names = [f"m{i}" for i in range(len(predictions))]
    frame = joined.join(split, "row_id").withColumn("features", array_to_vector(F.array(*names))).withColumn(
        "label", (F.col("outcome_count") > 0).cast("double"))
    frame = materialize(frame, "stack")
    meta = C.LogisticRegression(maxIter=50).fit(frame.filter(F.col("index") > 0))
    return positive_probability(meta.transform(frame)).select("row_id", "index", "outcome_count", "value")
