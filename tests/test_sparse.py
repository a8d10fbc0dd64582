"""Penalised regression on sparse covariates against dense brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.plans.prediction import sparse as P


def entries(frame, x):
    r, c = np.nonzero(x)
    return frame([(int(i), int(j) * 10 + 5, float(x[i, j])) for i, j in zip(r, c)], "row_id long, covariate_id long, covariate_value double")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    n, p = 240, 30
    x = (rng.random((n, p)) < 0.25) * rng.choice([1.0, 1.0, 2.5], size=(n, p))
    x[:, 3] = x[:, 2]  # a twin
    x[:, 7] = 40 + 10 * rng.random(n)  # far from zero
    lp = -1 + 1.2 * x[:, 0] - 0.9 * x[:, 1] + 0.7 * x[:, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-lp))).astype(float)
    day = np.ceil(rng.exponential(30 * np.exp(-lp / 2))).clip(1, 60)
    event = ((day < 60) & (rng.random(n) < 0.8)).astype(float)
    return x, y, day, event, 1 + np.arange(n) % 3


def rows(frame, x, y, fold, day=None):
    pop = frame([(i, float(y[i]), int(fold[i]), float(0 if day is None else day[i])) for i in range(len(y))], "row_id long, label double, part int, time double")
    return P.sparse_rows(entries(frame, x), pop, F.col("label"), F.col("part"), F.col("time"))


def logistic_parts(x, y, beta, constant):
    eta = constant + x @ beta
    mean = 1 / (1 + np.exp(-eta))
    return float((np.logaddexp(0, eta) - y * eta).sum()), x.T @ (mean - y), float((mean - y).sum())


def cox_parts(x, y, day, beta):
    eta = x @ beta
    loss, gradient = 0.0, np.zeros(x.shape[1])
    for i in np.flatnonzero(y):
        risk = day >= day[i]
        w = np.exp(eta[risk])
        loss += np.log(w.sum()) - eta[i]
        gradient += x[risk].T @ w / w.sum() - x[i]
    return float(loss), gradient


def conditions(beta, gradient, limit):
    on = beta != 0
    assert np.abs(gradient[on] + limit * np.sign(beta[on])).max(initial=0) < 1e-5
    assert np.abs(gradient[~on]).max(initial=0) < limit + 1e-5


@pytest.mark.parametrize("block", [256, 12])
def test_logistic_path_is_optimal_and_chosen_by_held_out_loss(frame, data, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "CHUNK", 50)
    x, y, _, _, fold = data
    found = P.lasso_path(*rows(frame, x, y, fold), count=4, ratio=0.08, tolerance=1e-9)
    assert len(found.steps) == 4 * 4 and not found.steps[0].beta.any()
    totals = {}
    for s in found.steps:
        train = fold != s.fold
        loss, gradient, slope = logistic_parts(x[train], y[train], s.beta, s.constant)
        assert loss == pytest.approx(s.loss) and abs(slope) < 1e-5 and (s.rows, s.held_rows) == (train.sum(), (~train).sum())
        conditions(s.beta, gradient, s.penalty * train.sum())
        if s.fold:
            held = logistic_parts(x[~train], y[~train], s.beta, s.constant)[0]
            assert held == pytest.approx(s.held_loss)
            totals[s.penalty] = totals.get(s.penalty, 0) + held
    assert found.final.penalty == min(totals, key=totals.get)
    assert found.final.violation < 1e-8
    table = {r.covariate_id: r.coefficient for r in found.coefficients().collect()}
    assert table == {10 * j + 5: b for j, b in enumerate(found.final.beta.tolist()) if b}
    assert found.fold_losses().count() == 12


def test_cox_path_is_optimal(frame, data):
    x, _, day, event, fold = data
    found = P.lasso_path(*rows(frame, x, event, fold, day), family="cox", count=3, ratio=0.05, tolerance=1e-8)
    for s in found.steps:
        train = fold != s.fold
        loss, gradient = cox_parts(x[train], event[train], day[train], s.beta)
        assert loss == pytest.approx(s.loss)
        conditions(s.beta, gradient, s.penalty * train.sum())
        if s.fold:
            assert cox_parts(x[~train], event[~train], day[~train], s.beta)[0] == pytest.approx(s.held_loss)
    assert any(s.beta.any() for s in found.steps)


def test_ten_thousand_features_take_bounded_blocks(spark):
    n, p = 3000, 10_000
    pop = spark.range(n).select(F.col("id").alias("row_id"), (F.xxhash64("id") % 10).alias("h"))
    some = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.pmod(F.xxhash64("row_id", k), F.lit(p)))).alias("covariate_id")
    cov = pop.select("row_id", some).distinct().withColumn("covariate_value", F.lit(1.0))
    signal = cov.filter("covariate_id < 1500").groupBy("row_id").agg((F.count("*") > 2).alias("s"))
    pop = pop.join(signal, "row_id", "left").select("row_id", F.coalesce(F.col("s"), F.col("h") == 0).cast("double").alias("y"), (1 + F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(50))).alias("t"))
    table, index = P.sparse_rows(cov, pop, F.col("y"), None, F.col("t"))
    for family in ("logistic", "cox"):
        found = P.lasso_path(table, index, family, count=3, ratio=0.5, tolerance=1e-6)
        assert index.count() > 9000 and found.final.violation <= 1e-12 * n and np.count_nonzero(found.final.beta) > 5


def test_empty_rows_and_one_outcome(frame, data):
    x, y, _, _, fold = data
    table, index = rows(frame, x, np.ones(len(y)), fold)
    with pytest.raises(ValueError):
        P.lasso_path(table, index)
    table, index = rows(frame, np.zeros((6, 2)), np.array([0, 1, 0, 1, 1, 0]), np.zeros(6, int))
    found = P.lasso_path(table, index, count=2)
    assert found.coefficients().count() == 0 and found.final.constant == pytest.approx(0)
