import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspan.plans.prediction import evaluate as E
from vitalspan.plans.prediction import features as X
from vitalspan.plans.prediction import models as M
from vitalspan.plans.prediction import population as N
from vitalspan.plans.prediction import split as S


def predictions(frame, n=120, seed=2):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.3), round(rng.choice([0.1, 0.25, 0.5, rng.random() * 0.9 + 0.05]), 6)) for i in range(n)]
    return frame(rows, "row_id long, outcome_count long, value double"), rows


def test_auc_counts_pairs_with_half_for_ties(frame):
    df, rows = predictions(frame)
    pairs = [(p[2], n[2]) for p, n in itertools.product([r for r in rows if r[1]], [r for r in rows if not r[1]])]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    auc = E.auc(df).first().auc
    assert auc == pytest.approx(brute)
    assert E.auc(df.withColumn("value", 1 - F.col("value"))).first().auc == pytest.approx(1 - auc)


def test_thresholds_and_calibration_add_up(frame):
    df, rows = predictions(frame)
    t = E.threshold_summary(df).collect()
    assert all(r.true_positive_count + r.false_negative_count == sum(y for _, y, _ in rows) for r in t)
    assert all(r.positive_count + r.negative_count == len(rows) for r in t)
    bins = E.calibration_summary(df).collect()
    assert len(bins) == 10 and sum(b.person_count for b in bins) == len(rows)


def test_ici_equals_brute_force_local_regression(frame):
    rng = random.Random(21)
    rows = [(i, int(rng.random() < 0.1 + 0.6 * v), v) for i, v in enumerate(rng.choice([0.05, 0.1, 0.2, 0.22, 0.35, 0.5, 0.7, 0.71, 0.9]) for _ in range(150))]
    x, y = np.array([r[2] for r in rows]), np.array([float(r[1]) for r in rows])
    total = 0.0
    for at in x:
        far = np.abs(x - at)
        h = np.sort(far)[math.ceil(0.75 * len(x)) - 1]
        w = np.where(far < h, (1 - (np.minimum(far, h) / h) ** 3) ** 3, 0.0) ** 0.5
        design = np.stack([np.ones_like(x), x - at, (x - at) ** 2], 1)
        total += abs(at - np.linalg.lstsq(design * w[:, None], y * w, rcond=None)[0][0])
    found = E.ici(frame(rows, "row_id long, outcome_count long, value double")).first().ici
    assert found == pytest.approx(total / len(x), abs=1e-9)
    assert E.ici(frame(rows[:0], "row_id long, outcome_count long, value double")).first().ici is None


def test_ici_is_zero_for_perfect_calibration(frame):
    df = frame([(i, y, v) for i, (y, v) in enumerate([(1, .5), (0, .5), (0, .25), (0, .25), (0, .25), (1, .25)])], "row_id long, outcome_count long, value double")
    assert E.ici(df).first().ici == pytest.approx(0.0)


def test_recalibration_fixes_the_mean(frame):
    df, rows = predictions(frame)
    shifted, _ = E.recalibrate_in_large(df)
    rate = sum(y for _, y, _ in rows) / len(rows)
    assert shifted.agg(F.avg("value")).first()[0] == pytest.approx(rate, abs=1e-9)
    weak, a, b = E.recalibrate_weak(df)
    again = E.recalibrate_weak(weak)
    assert again[1] == pytest.approx(0, abs=1e-6) and again[2] == pytest.approx(1, abs=1e-6)


def test_survival_matches_product(frame):
    times = [(i, t, y) for i, (t, y) in enumerate([(1, 1), (2, 0), (2, 1), (3, 1), (5, 0), (5, 1)])]
    df = frame(times, "row_id long, survival_time long, outcome_count long")
    s, expected = 1.0, {}
    for t in sorted({t for _, t, _ in times}):
        at_risk = sum(u >= t for _, u, _ in times)
        s *= 1 - sum(y for _, u, y in times if u == t) / at_risk
        expected[t] = s
    got = {r.day: r.survival for r in E.survival_curve(df).collect()}
    assert got == pytest.approx(expected)


def population(frame):
    rows = [
        # row, subject, days from obs start, to cohort end, to obs end
        (1, 1, 100, 30, 400), (2, 2, 100, 30, 20), (3, 3, 100, 30, 20), (4, 4, 100, 30, 400),
    ]
    df = frame(rows, "row_id long, subject_id long, days_from_obs_start long, days_to_cohort_end long, days_to_obs_end long")
    df = df.withColumn("cohort_start_date", F.lit("2001-01-01").cast("date"))
    events = frame([(3, 9, 10), (4, 9, -5), (1, 9, 50)], "subject_id long, outcome_id long, days int")
    return df, events.withColumn("event_date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("days")))


@pytest.mark.parametrize("prior,require,everyone,kept", [
    (False, False, False, {1, 2, 3, 4}), (False, True, False, {1, 4}), (False, True, True, {1, 3, 4}),
    (True, False, False, {1, 2, 3}), (True, True, False, {1}), (True, True, True, {1, 3}),
])
def test_population_switches(frame, prior, require, everyone, kept):
    rows, events = population(frame)
    spec = N.PopulationSpec(remove_prior_outcome=prior, require_time_at_risk=require, include_all_outcomes=everyone, min_time_at_risk=364)
    got = {r.row_id: r.outcome_count for r in N.study_population(rows, events, 9, spec).collect()}
    assert set(got) == kept
    assert all(y == (1 if r in (1, 3) else 0) for r, y in got.items())


def test_splits_are_disjoint_and_stable(frame):
    rng = random.Random(1)
    pop = frame([(i, i // 3, int(rng.random() < 0.2)) for i in range(300)], "row_id long, subject_id long, outcome_count long")
    spec = S.SplitSpec("subject")
    idx = S.split(pop, spec)
    assert sorted(map(tuple, idx.collect())) == sorted(map(tuple, S.split(pop, spec).collect()))
    sides = pop.join(idx, "row_id").groupBy("subject_id").agg(F.countDistinct("index").alias("n"))
    assert sides.filter("n > 1").count() == 0
    strat = pop.join(S.split(pop, S.SplitSpec()), "row_id")
    shares = {r.outcome_count: r.s for r in strat.groupBy("outcome_count").agg(F.avg((F.col("index") < 0).cast("double")).alias("s")).collect()}
    assert abs(shares[0] - 0.25) < 0.02 and abs(shares[1] - 0.25) < 0.04


@pytest.mark.parametrize("k", [1, 5, 60])
def test_neighbours_equal_brute_force(frame, k):
    rng = random.Random(4)
    cov = [(i, c, float(rng.randint(1, 4))) for i in range(80) for c in range(1, 9) if rng.random() < (0.9 if c == 1 else 0.4 / c)]
    cov += [(70, 99, 3.0), (5, 2, 0.0)]  # unknown to the training rows; an explicit zero
    vectors = {i: np.zeros(100) for i in range(82)}
    for i, c, v in cov:
        vectors[i][c] += v
    cov = frame(cov, "row_id long, covariate_id long, covariate_value double")
    pop = frame([(i, int(i % 3 == 0)) for i in range(82)], "row_id long, outcome_count long")
    model = M.fit_knn(cov, pop.filter("row_id < 50"), k)
    got = {}
    for r in model.neighbours(cov, pop.filter("row_id >= 50")).collect():
        got.setdefault(r.row_id, []).append((r.distance, r.neighbour))
    for i in range(50, 82):
        x = vectors[i].copy()
        x[99] = 0
        want = sorted((round(float(((x - vectors[t]) ** 2).sum()), 9), t) for t in range(50))[:k]
        assert sorted(got[i]) == want
    value = {r.row_id: r.value for r in model.predict(cov, pop.filter("row_id >= 50")).collect()}
    assert value == pytest.approx({i: np.mean([t % 3 == 0 for _, t in n]) for i, n in got.items()})


def test_neighbours_do_not_meet_all_pairs(frame, spark):
    pop = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("outcome_count"))
    rare = pop.select("row_id", F.explode(F.array(*[F.lit(10 + 50 * j) + F.pmod(F.xxhash64("row_id", F.lit(j)), F.lit(50)) for j in range(6)])).alias("covariate_id"))
    cov = rare.unionByName(pop.select("row_id", F.lit(1).cast("long").alias("covariate_id"))).withColumn("covariate_value", F.lit(1.0))
    model = M.fit_knn(cov, pop.filter("row_id < 2500"), 3)
    seen = []
    plain = type(model)._distances
    model._distances = lambda pairs, test: seen.append(pairs.count()) or plain(model, pairs, test)
    assert model.neighbours(cov, pop.filter("row_id >= 2500")).count() == 1500
    assert sum(seen) < 0.5 * 500 * 2500
    with pytest.raises(Exception, match="zero or more"):
        M.fit_knn(frame([(1, 1, -1.0)], "row_id long, covariate_id long, covariate_value double"), pop, 1)


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_among_common_covariates_are_found_in_blocks(frame, monkeypatch, k):
    from vitalspan.plans.prediction import neighbours as B

    monkeypatch.setattr(B, "TEST_ROWS", 16)
    monkeypatch.setattr(B, "TRAINING_ROWS", 50)
    rng = random.Random(8)
    vectors = {i: {c: rng.choice([1.0, 0.1, 2 / 3]) for c in range(1, 12) if rng.random() < 0.5} for i in range(260)}
    vectors[3], vectors[240] = {}, {}
    cov = frame([(i, c, v) for i, e in vectors.items() for c, v in e.items()], "row_id long, covariate_id long, covariate_value double")
    pop = frame([(i, int(i % 3 == 0)) for i in vectors], "row_id long, outcome_count long")
    twice = [t for t in range(200) if t % 4 == 0]
    model = M.fit_knn(cov, pop.filter("row_id < 200").unionByName(pop.filter("row_id < 200 AND row_id % 4 = 0")), k)
    seen, plain = [], type(model)._distances
    model._distances = lambda pairs, test: seen.append(pairs.count()) or plain(model, pairs, test)
    got = {}
    for r in model.neighbours(cov, pop.filter("row_id >= 200")).collect():
        got.setdefault(r.row_id, []).append((r.distance, r.neighbour))
    for i in range(200, 260):
        x = vectors[i]
        far = {t: sum((x.get(c, 0) - vectors[t].get(c, 0)) ** 2 for c in range(1, 12)) for t in range(200)}
        assert sorted(got[i]) == sorted((round(far[t], 9), t) for t in [*far, *twice])[:k]
    assert seen[1] <= 60 * k * 4 < 0.1 * 60 * 200


def test_permutation_importance_equals_rescoring(frame):
    rng = random.Random(12)
    cov = frame([(i, c, float(rng.randint(1, 3))) for i in range(120) for c in (11, 12, 13) if rng.random() < 0.5], "row_id long, covariate_id long, covariate_value double")
    rows = [(i, int(rng.random() < 0.4)) for i in range(120)]
    pop = frame(rows, "row_id long, outcome_count long")
    beta = {11: 0.5, 12: -0.5, 13: 0.25, 14: 1.0}
    scorer = M.LinearScorer(frame(list(beta.items()), "covariate_id long, coefficient double"), -0.2)
    got = {r.covariate_id: r.importance for r in M.permutation_importance(scorer, cov, pop, [11, 12, 13, 14], seed=3).collect()}
    values = {}
    for r in cov.collect():
        values[r.row_id, r.covariate_id] = r.covariate_value
    donors = [r.row_id for r in pop.orderBy(M.hash_order("row_id", seed=3)).collect()]
    y = dict(rows)

    def area(moved):
        score = {i: round(-0.2 + sum(b * values.get((donors[i] if c == moved else i, c), 0) for c, b in beta.items()), 9) for i in y}
        pairs = [(score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i in y if y[i] for j in y if not y[j]]
        return sum(pairs) / len(pairs)

    assert got == pytest.approx({c: area(None) - area(c) for c in beta})


def test_cox_gradient_vanishes(frame):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        x, z = rng.random(), float(rng.random() < 0.5)
        t = max(1, min(60, int(rng.expovariate(0.03 * math.exp(0.8 * x - 0.5 * z))) + 1))
        rows.append((i, x, z, t, float(t < 60)))
    model = M.fit_cox(frame(rows, "row_id long, x double, z double, t long, e double"), ["x", "z"], "t", "e")
    beta = np.array(model.beta)
    xs = np.array([[r[1], r[2]] for r in rows])
    t, e = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    risk, gradient = np.exp(xs @ beta), np.zeros(2)
    for i in range(len(rows)):
        if e[i]:
            at = t >= t[i]
            gradient += xs[i] - (risk[at, None] * xs[at]).sum(0) / risk[at].sum()
    assert np.abs(gradient).max() < 1e-4


def test_age_spline_equals_numpy(frame):
    rng = random.Random(6)
    rows = [(i, rng.randint(18, 90), int(rng.random() < 0.3)) for i in range(150)]
    df = frame(rows, "row_id long, age_year long, outcome_count long")
    fitted, knots, beta = X.age_spline(df)
    x, y = np.array([float(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    assert knots == pytest.approx(list(np.quantile(x, X.SPLINE_KNOTS)))
    k = list(dict.fromkeys(knots))
    cube = lambda c: np.maximum(x - c, 0) ** 3
    cols = [np.ones_like(x), x] + [
        (cube(t) - cube(k[-2]) * (k[-1] - t) / (k[-1] - k[-2]) + cube(k[-1]) * (k[-2] - t) / (k[-1] - k[-2])) / (k[-1] - k[0]) ** 2
        for t in k[:-2]]
    design = np.stack(cols, 1)
    expected = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = np.array([r.covariate_value for r in fitted.orderBy("row_id").collect()])
    assert np.abs(got - expected).max() < 1e-6


def test_linear_scorer_equals_vector_model(frame):
    rng = random.Random(8)
    cov = frame([(i, c, 1.0) for i in range(120) for c in (11, 12, 13) if rng.random() < 0.5], "row_id long, covariate_id long, covariate_value double")
    pop = frame([(i, int(rng.random() < 0.4)) for i in range(120)], "row_id long, outcome_count long")
    model = M.fit(cov, pop, M.ModelSpec("lasso_lr", (("regParam", 0.001),)))
    a = {r.row_id: r.value for r in model.predict(cov, pop).collect()}
    b = {r.row_id: r.value for r in M.linear_scorer(model.classifier, model.index).predict(cov, pop).collect()}
    assert a == pytest.approx(b)


def test_vectors_are_sparse_without_python(frame, spark):
    wide = [(1, i, 1.0) for i in range(3000)] + [(2, 5, 1.5), (2, 5, 1.0), (2, 2999, 2.0)]
    vectors, index = X.to_vectors(spark.createDataFrame(wide, "row_id long, covariate_id long, covariate_value double"))
    got = {r.row_id: r.features for r in vectors.collect()}
    assert index.count() == 3000 and got[1].size == 3000 and got[1].toArray().sum() == 3000
    assert dict(zip(got[2].indices.tolist(), got[2].values.tolist(), strict=True)) == {5: 2.5, 2999: 2.0}
    assert "Python" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_evaluation_frames_fit_the_result_store(frame, tmp_path, spark):
    from vitalspan.sources import store

    df, rows = predictions(frame)
    df = df.withColumn("age_year", 40 + F.col("row_id") % 20).withColumn("gender", F.lit(8507))
    frames = E.evaluate(df)
    stats = {r.metric: r.value for r in frames["evaluation_statistics"].collect()}
    assert stats["population_size"] == len(rows) and 0 <= stats["auc"] <= 1
    store.write_result(frames["evaluation_statistics"].withColumn("performance_id", F.lit(1)), "evaluation_statistics", str(tmp_path))
    store.write_result(frames["threshold_summary"].withColumn("performance_id", F.lit(1)), "threshold_summary", str(tmp_path))
    assert store.read_result(spark, "evaluation_statistics", str(tmp_path)).count() == len(stats)
    assert store.read_result(spark, "threshold_summary", str(tmp_path)).first().prediction_threshold is not None


def test_generated_designs_skip_done_ones(frame):
    from vitalspan.plans.prediction import multi as U

    todo = U.designs([1, 3], [3], [N.PopulationSpec()], [M.ModelSpec("dt"), M.ModelSpec("rf")])
    assert [(d.target_id, d.model.kind) for d in todo] == [(1, "dt"), (1, "rf")]
    assert len({d.key() for d in todo}) == 2


class MeanLearner:
    """Outcome share of the training rows with the same covariate 11."""

    kind = "mean"

    def __init__(self, log=None, fail=0):
        self.log, self.fail = log, fail

    def __repr__(self):
        return "mean"

    def fit(self, covariates, population):
        if self.log is not None:
            self.log.append(1)
            if len(self.log) == self.fail:
                raise KeyboardInterrupt
        flag = covariates.filter("covariate_id = 11").select("row_id", F.lit(1).alias("f"))
        rates = population.join(flag, "row_id", "left").groupBy(F.coalesce("f", F.lit(0)).alias("f")).agg(F.avg("outcome_count").alias("value"))
        return type("Rates", (), {"predict": lambda self, c, p: p.join(flag, "row_id", "left").withColumn("f", F.coalesce("f", F.lit(0))).join(rates, "f")})()


@pytest.fixture
def labelled(frame):
    rng = random.Random(17)
    cov = frame([(i, c, 1.0) for i in range(300) for c in (11, 12) if rng.random() < 0.5], "row_id long, covariate_id long, covariate_value double")
    pop = frame([(i, int(rng.random() < 0.3)) for i in range(300)], "row_id long, outcome_count long")
    return cov, pop, frame([(i, (i % 4) or -1) for i in range(300)], "row_id long, index long")


def test_cross_validation_scores_every_held_out_row_once(labelled):
    cov, pop, folds = labelled
    scored, table = M.cross_validate(cov, pop, folds, [MeanLearner(), MeanLearner()], workers=3)
    assert scored.groupBy("setting", "row_id").count().filter("count > 1").count() == 0 and scored.count() == 2 * 225
    rows = table.collect()
    assert {(r.setting, r.fold, r.rows) for r in rows} == {(s, f, 75 if f else 225) for s in (0, 1) for f in range(4)}
    assert {r.setting for r in rows if r.best} == {0}


def test_learning_curve_by_outcomes_is_exact_and_nested(labelled):
    cov, pop, split = labelled
    curve = M.learning_curve(cov, pop, split, MeanLearner(), fractions=(1.0,), events=(1, 7, 30, 10_000))
    rows = {r.events: r for r in curve.collect()}
    assert [(e, rows[e].outcomes) for e in (1, 7, 30)] == [(1, 1), (7, 7), (30, 30)] and 10_000 not in rows
    assert rows[1].rows < rows[7].rows < rows[30].rows < rows[None].rows == 225


def test_boosted_coordinates_lower_the_loss(labelled):
    from vitalspan.plans.prediction import sparse as P

    cov, pop, _ = labelled
    rows, index = P.sparse_rows(cov, pop, F.col("outcome_count") > 0)
    found = P.coordinate_boosting(rows, index, rounds=12, rate=1.9)
    assert len(found.losses) == 13 and all(a >= b for a, b in zip(found.losses, found.losses[1:], strict=False))
    long = P.coordinate_boosting(rows, index, rounds=150, rate=0.5, l2=0.0)
    assert long.losses[-1] == pytest.approx(P.lasso_path(rows, index, penalties=[0.0]).final.loss, abs=1e-6)


def test_designs_resume_from_their_manifest(frame, cdm, tmp_path):
    from vitalspan.catalog import q_prediction as Q
    from vitalspan.plans.prediction import multi as U

    rows = Q.target_rows(cdm).withColumn("cohort_definition_id", F.lit(4)) if "cohort_definition_id" not in Q.target_rows(cdm).columns else Q.target_rows(cdm)
    cov = Q.covariates(cdm).withColumn("covariate_id", F.when(F.col("covariate_id") % 1000 == 1, 11).otherwise(F.col("covariate_id")))
    log = []
    todo = U.designs([4], [3], U.with_risk_ends(Q.SPEC, [90, 180, 365]), [MeanLearner(log)])
    killed = U.designs([4], [3], U.with_risk_ends(Q.SPEC, [90, 180, 365]), [MeanLearner([], fail=2)])
    folder = str(tmp_path / "designs")
    with pytest.raises(KeyboardInterrupt):
        U.run_multiple(rows, {"all": cov}, cdm.cohort, killed, manifest=folder, workers=1)
    before = U.finished(cdm.spark, folder).count()
    assert before in (1, 2)
    again = U.run_multiple(rows, {"all": cov}, cdm.cohort, todo, manifest=folder, workers=2)
    assert len(log) == 3 - before and sorted(r.risk_end for r in again.collect()) == [90, 180, 365]
    assert U.run_multiple(rows, {"all": cov}, cdm.cohort, todo, manifest=folder).count() == 3 and len(log) == 3 - before
    assert len(U.designs([1, 4], [3], [Q.SPEC], [MeanLearner()], restrict=lambda d: d.covariates == "b", covariates=["a", "b"])) == 2


def _weak(spark, rows=400):
    """Half the rows have a covariate that outcomes hardly depend on."""
    data = [(i, i % 2, int(i % 4 < 2) if i else 0) for i in range(rows)]
    population = spark.createDataFrame([(i, y) for i, _, y in data], "row_id long, outcome_count int")
    covariates = spark.createDataFrame([(i, 7, 1.0) for i, x, _ in data if x], "row_id long, covariate_id long, covariate_value double")
    return covariates, population


def test_iht_whose_start_drops_every_covariate_still_keeps_the_largest(spark):
    covariates, population = _weak(spark)
    model = M.fit_iht(covariates, population, 2)
    assert [r.covariate_id for r in model.coefficients.collect()] == [7]
    shares = {round(r.value, 4) for r in model.predict(covariates, population).collect()}
    assert shares == {0.5, 0.495}


def test_learners_without_covariates_predict_the_share(spark):
    covariates, population = _weak(spark)
    for model in (M.fit(covariates.limit(0), population, M.ModelSpec()), M.fit_iht(covariates.limit(0), population, 2)):
        assert {round(r.value, 6) for r in model.predict(covariates, population).collect()} == {0.4975}
        assert M.kept_covariates(model).count() == 0
    none = M.fit(covariates.limit(0), population.withColumn("outcome_count", F.lit(0)), M.ModelSpec())
    assert {r.value for r in none.predict(covariates, population).collect()} == {0.0}
