"""Exact performance measures over prediction frames.

A prediction frame has ``row_id``, ``outcome_count`` (0/1) and ``value``.
Scores are grouped first; cumulative counts then run per score bucket, so no
measure sorts all predictions in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.ranks import order_bucket, row_numbers, running_totals
from vitalspan.operators.summaries import value_counts
from vitalspan.session import materialize, share_code


def _y() -> Column:
    return (F.col("outcome_count") > 0).cast("long")


def by_score(prediction: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return prediction.groupBy(*(keys or []), "value").agg(
        F.sum(_y()).alias("pos"), F.sum(1 - _y()).alias("neg"))


def auc(prediction: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    keys = keys or []
    cum = running_totals(by_score(prediction, keys), keys, "value", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    pairs = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return cum.groupBy(*keys).agg((pairs / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def auprc(prediction: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average precision over distinct scores from the top."""
    keys = keys or []
    cum = running_totals(by_score(prediction, keys), keys, "value", ["pos", "neg"], descending=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.groupBy(*keys).agg((F.sum(F.col("pos") * precision) / F.sum("pos")).alias("auprc"))


def brier(prediction: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean squared error and the share of the base-rate error it removes."""
    y = _y().cast("double")
    stats = prediction.groupBy(*(keys or [])).agg(
        F.avg((y - F.col("value")) * (y - F.col("value"))).alias("brier"), F.avg(y).alias("_rate"))
    return stats.withColumn("scaled_brier", 1 - F.col("brier") / (F.col("_rate") * (1 - F.col("_rate")))).drop("_rate")


def _ratio(a, b) -> Column:
    return a / F.nullif(b, F.lit(0))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def preference_score(p: Column, prevalence: Column) -> Column:
    """Score recentred by the prevalence."""
    return 1 / (1 + F.exp(-(logit(p) - logit(prevalence))))


def threshold_summary(prediction: DataFrame) -> DataFrame:
    """Confusion counts and derived measures at every distinct score."""
    grouped = by_score(prediction)
    cum = running_totals(grouped, [], "value", ["pos", "neg"], descending=True)
    totals = grouped.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    base = cum.select(
        F.col("value").alias("prediction_threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        (p - F.col("cum_pos")).alias("fn"), (n - F.col("cum_neg")).alias("tn"), p.alias("p"), n.alias("n"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    ppv, npv = _ratio(tp, tp + fp), _ratio(tn, tn + fn)
    fnr, fpr = _ratio(fn, tp + fn), _ratio(fp, tn + fp)
    lr_pos, lr_neg = _ratio(sens, fpr), _ratio(fnr, spec)
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + fn))  # 2PR/(P+R)
    return base.select(
        "prediction_threshold",
        preference_score(F.col("prediction_threshold"), F.col("p") / (F.col("p") + F.col("n"))).alias("preference_threshold"),
        (F.col("tp") + F.col("fp")).alias("positive_count"), (F.col("tn") + F.col("fn")).alias("negative_count"),
        F.col("p").alias("true_count"), F.col("n").alias("false_count"),
        F.col("tp").alias("true_positive_count"), F.col("tn").alias("true_negative_count"),
        F.col("fp").alias("false_positive_count"), F.col("fn").alias("false_negative_count"),
        f1.alias("f_1_score"), ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        sens.alias("sensitivity"), fnr.alias("false_negative_rate"), fpr.alias("false_positive_rate"),
        spec.alias("specificity"), ppv.alias("positive_predictive_value"), _ratio(fp, tp + fp).alias("false_discovery_rate"),
        npv.alias("negative_predictive_value"), _ratio(fn, tn + fn).alias("false_omission_rate"),
        lr_pos.alias("positive_likelihood_ratio"), lr_neg.alias("negative_likelihood_ratio"),
        _ratio(lr_pos, lr_neg).alias("diagnostic_odds_ratio"))


def interpolated_percentiles(values: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles interpolated between neighbouring ranks, from grouped values."""
    counts = value_counts(values, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    cum = running_totals(counts, keys, "value", ["n"]).join(totals, keys)
    picks = []
    for name, q in quantiles.items():
        spot = (F.col("_total") - 1) * F.lit(float(q))
        at = lambda rank: F.min(F.when(F.col("cum_n") >= rank + 1, F.col("value")))
        lower, upper, part = at(F.floor(spot)), at(F.ceil(spot)), F.first(spot - F.floor(spot))
        picks.append((lower + (upper - lower) * part).alias(name))
    return cum.groupBy(*keys).agg(*picks)


def _spread(prediction: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    stats = prediction.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("person_count"), F.sum(_y()).alias("outcomes"), F.avg("value").alias("average"),
        F.stddev_samp("value").alias("st_dev"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(interpolated_percentiles(prediction, keys, "value", quantiles), keys)


def ntile(rank: Column, total: Column, tiles: int) -> Column:
    """Tile 1..n of a row number; the first tiles take the remainder."""
    base, extra = F.floor(total / tiles), total % tiles
    large = extra * (base + 1)
    return F.when(rank <= large, F.floor((rank - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((rank - large - 1) / F.greatest(base, F.lit(1))) + 1).cast("long")


def calibration_bins(prediction: DataFrame, tiles: int = 10) -> DataFrame:
    slim = materialize(prediction.select("row_id", "outcome_count", "value"), "scores")
    rows = row_numbers(slim, [], ["value", "row_id"], "_rn")
    total = slim.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn("bin", ntile(F.col("_rn"), total, tiles)).drop("_rn")


def calibration_summary(prediction: DataFrame, tiles: int = 10) -> DataFrame:
    """Predicted against observed risk by tenths of the predictions."""
    binned = materialize(calibration_bins(prediction, tiles), "calibration")
    return _spread(binned, ["bin"], {"p_25": 0.25, "median": 0.5, "p_75": 0.75}).withColumn(
        "observed_incidence", F.col("outcomes") / F.col("person_count"))


def calibration_line(prediction: DataFrame, tiles: int = 10) -> DataFrame:
    """Regression of observed on predicted risk over the tenths, and the two
    means for calibration in the large."""
    bins = calibration_bins(prediction, tiles).groupBy("bin").agg(
        F.avg("value").alias("x"), F.avg(_y().cast("double")).alias("y"))
    line = bins.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    means = prediction.agg(F.avg("value").alias("m"), F.avg(_y().cast("double")).alias("o"))
    return line.withColumn("mean_predicted", means.select("m").scalar()).withColumn(
        "mean_observed", means.select("o").scalar())


def local_regression(x0: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, span: float) -> np.ndarray:
    """Locally weighted quadratic regression of weighted points, at ``x0``.

    The bandwidth is the distance within which a share ``span`` of the weight
    lies; weights fall by the tricube of the distance.
    """
    out = np.empty(len(x0))
    wanted = math.ceil(span * w.sum() - 1e-9)
    for i, at in enumerate(x0):
        d = x - at
        far = np.abs(d)
        order = np.argsort(far, kind="stable")
        h = far[order][min(np.searchsorted(np.cumsum(w[order]), wanted), len(order) - 1)]
        u = d / h if h > 0 else np.zeros(len(d))
        near = far < h if h > 0 else far == 0
        k = w[near] * (1 - np.abs(u[near]) ** 3) ** 3
        powers = u[near][None, :] ** np.arange(5)[:, None]
        moments, right = powers @ k, powers[:3] @ (k * y[near])
        out[i] = np.linalg.lstsq(moments[np.arange(3)[:, None] + np.arange(3)], right, rcond=1e-12)[0][0]
    return out


def ici(prediction: DataFrame, span: float = 0.75) -> DataFrame:
    """Integrated calibration index: mean distance between the score and the
    observed risk smoothed by local regression.

    The first pass reduces rows to moments of score buckets, whose number is
    bounded by the score resolution (1/2048 of a natural logarithm), not by
    the rows; the second smooths every bucket from all of them, spread over
    the tasks. An empty table gives null.
    """
    grid = prediction.withColumn("_b", order_bucket(prediction, "value")).groupBy("_b").agg(
        F.avg("value").alias("x"), F.avg(_y().cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    grid = materialize(grid.select("x", "y", "w"), "calibration-grid")
    points = grid.orderBy("x").toArrow()
    share_code(prediction.sparkSession)
    shared = prediction.sparkSession.sparkContext.broadcast([points.column(c).to_numpy() for c in ("x", "y", "w")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            smooth = local_regression(b.column(0).to_numpy(), *shared.value, span)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(smooth)], names=["x", "w", "smooth"])

    spread = grid.select("x", "w").repartition(max(1, points.num_rows // 500), "x")
    smoothed = spread.mapInArrow(work, "x double, w double, smooth double")
    return smoothed.agg((F.sum(F.col("w") * F.abs(F.col("x") - F.col("smooth"))) / F.sum("w")).alias("ici"))


def prediction_distribution(prediction: DataFrame) -> DataFrame:
    """Spread of the scores by outcome class."""
    tagged = prediction.withColumn("class_label", _y())
    return _spread(tagged, ["class_label"], {"p_05": 0.05, "p_25": 0.25, "median": 0.5, "p_75": 0.75, "p_95": 0.95})


def demographic_summary(prediction: DataFrame) -> DataFrame:
    """Predicted and observed risk by five-year band and gender."""
    tagged = prediction.withColumn("age_group", F.floor(F.col("age_year") / 5) * 5)
    return _spread(tagged, ["age_group", "gender"], {"p_25": 0.25, "p_50": 0.5, "p_75": 0.75})


def covariate_summary(covariates: DataFrame, population: DataFrame) -> DataFrame:
    """Counts, zero-filled means and deviations of each covariate overall and
    by outcome, with the standardized mean difference."""
    labels = population.select("row_id", _y().alias("_y"))
    x = F.col("covariate_value")
    per_class = covariates.join(labels, "row_id").groupBy("covariate_id").agg(*[
        agg(F.when(test, x)).alias(f"{stat}_{tag}")
        for tag, test in (("all", F.lit(True)), ("1", F.col("_y") == 1), ("0", F.col("_y") == 0))
        for stat, agg in (("n", F.count), ("s", F.sum), ("q", lambda c: F.sum(c * c)))])
    sizes = labels.agg(F.count(F.lit(1)).alias("all"), F.sum("_y").alias("1"), F.sum(1 - F.col("_y")).alias("0"))
    size = {t: sizes.select(f"`{t}`").scalar() for t in ("all", "1", "0")}
    out = per_class.select(
        "*", *[size[t].alias(f"size_{t}") for t in ("all", "1", "0")]).fillna(0.0)
    cols = ["covariate_id"]
    for tag, prefix in (("all", ""), ("0", "with_no_outcome_"), ("1", "with_outcome_")):
        n, s, q = F.col(f"size_{tag}"), F.col(f"s_{tag}"), F.col(f"q_{tag}")
        mean = s / F.nullif(n, F.lit(0))
        var = (q - s * s / n) / F.nullif(n - 1, F.lit(0))
        cols += [F.col(f"n_{tag}").alias(f"{prefix}covariate_count"), mean.alias(f"{prefix}covariate_mean"),
                 F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"{prefix}covariate_st_dev")]
    flat = out.select(*cols)
    gap = F.sqrt((F.col("with_outcome_covariate_st_dev") ** 2 + F.col("with_no_outcome_covariate_st_dev") ** 2) / 2)
    return flat.withColumn(
        "standardized_mean_diff",
        F.when(gap > 0, (F.col("with_outcome_covariate_mean") - F.col("with_no_outcome_covariate_mean")) / gap))


def generalizability(covariates: DataFrame, split: DataFrame) -> DataFrame:
    """Covariate means in the training and the test rows."""
    side = split.select("row_id", F.when(F.col("index") < 0, "test").otherwise("train").alias("side"))
    sizes = side.groupBy("side").agg(F.count(F.lit(1)).alias("size"))
    sums = covariates.join(side, "row_id").groupBy("covariate_id", "side").agg(F.sum("covariate_value").alias("s"))
    means = sums.join(sizes, "side").withColumn("mean", F.col("s") / F.col("size"))
    return means.groupBy("covariate_id").agg(*[
        F.coalesce(F.max(F.when(F.col("side") == s, F.col("mean"))), F.lit(0.0)).alias(f"{s}_mean") for s in ("train", "test")])


def survival_curve(population: DataFrame) -> DataFrame:
    """Kaplan-Meier by day: at risk, events and survival. Days bound the rows."""
    daily = population.groupBy(F.col("survival_time").alias("day")).agg(
        F.sum((F.col("outcome_count") > 0).cast("long")).alias("events"), F.count(F.lit(1)).alias("leaving"))
    cum = running_totals(daily, [], "day", ["leaving"], descending=True).withColumnRenamed("cum_leaving", "at_risk")
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(0.0))
    gone = (F.col("events") >= F.col("at_risk")).cast("long")
    logs = cum.withColumn("_log", step).withColumn("_gone", gone)
    run = running_totals(logs, [], "day", ["_log", "_gone"])
    return run.select(
        "day", "at_risk", "events", F.when(F.col("cum__gone") > 0, 0.0).otherwise(F.exp("cum__log")).alias("survival"))


def outcome_rate_trend(population: DataFrame) -> DataFrame:
    """Percent of rows with the outcome by age, gender and index year."""
    y = (F.col("outcome_count") > 0).cast("double")
    groups = {"age": F.col("age_year"), "gender": F.col("gender"), "year": F.year("cohort_start_date")}
    long = population.select(y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("aggregation"), c.cast("long").alias("xvalue")) for k, c in groups.items()])).alias("g"))
    return long.groupBy("g.aggregation", "g.xvalue").agg(
        (F.avg("y") * 100).alias("outcome_percent"), F.count(F.lit(1)).alias("rows"))


def model_concordance(prediction: DataFrame) -> DataFrame:
    """Concordance expected under the model itself; equal scores count half."""
    grouped = prediction.groupBy("value").agg(F.count(F.lit(1)).alias("m")).select(
        "value", "m", (F.col("value") * F.col("m")).alias("p"), ((1 - F.col("value")) * F.col("m")).alias("q"))
    cum = running_totals(grouped, [], "value", ["q"])
    within = F.col("value") * (1 - F.col("value")) * F.col("m") * (F.col("m") - 1)
    higher = F.sum(F.col("p") * (F.col("cum_q") - F.col("q")) + within / 2)
    own = F.sum(F.col("value") * (1 - F.col("value")) * F.col("m"))
    return cum.agg((higher / (F.sum("p") * F.sum("q") - own)).alias("concordance"))


# --- recalibration --------------------------------------------------------------
def _newton(prediction: DataFrame, slope: bool, rounds: int = 25) -> tuple[float, float]:
    """Intercept (and slope) of a logistic regression on logit(p). Each round
    is one aggregation to a handful of sums over grouped scores."""
    grouped = by_score(prediction).select(logit(F.col("value")).alias("x"), "pos", (F.col("pos") + F.col("neg")).alias("m"))
    grouped = materialize(grouped, "grouped-scores")
    a, b = 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = F.col("m") * p * (1 - p)
        r = F.col("pos") - F.col("m") * p
        g0, g1, h00, h01, h11 = grouped.agg(
            F.sum(r), F.sum(r * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") ** 2)).first()
        if slope:
            det = h00 * h11 - h01 * h01
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        else:
            da, db = g0 / h00, 0.0
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-12:
            break
    return a, b


def recalibrate_in_large(prediction: DataFrame) -> tuple[DataFrame, float]:
    a, _ = _newton(prediction, slope=False)
    return _shifted(prediction, a, 1.0), a


def recalibrate_weak(prediction: DataFrame) -> tuple[DataFrame, float, float]:
    a, b = _newton(prediction, slope=True)
    return _shifted(prediction, a, b), a, b


def _shifted(prediction: DataFrame, a: float, b: float) -> DataFrame:
    return prediction.withColumn("value", 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * logit(F.col("value"))))))


# --- collections ----------------------------------------------------------------
def evaluation_statistics(prediction: DataFrame) -> DataFrame:
    """Headline measures as (metric, value) rows."""
    y = _y()
    prediction = materialize(prediction.select("outcome_count", "value"), "scores")
    counts = prediction.agg(F.count(F.lit(1)).cast("double").alias("population_size"), F.sum(y).cast("double").alias("outcome_count"))
    frames = [counts, auc(prediction), auprc(prediction), brier(prediction)]
    long = [f.unpivot([], f.columns, "metric", "value") for f in frames]
    return reduce(DataFrame.unionByName, long)


def evaluate(prediction: DataFrame) -> dict[str, DataFrame]:
    prediction = materialize(prediction, "prediction")
    return {
        "evaluation_statistics": evaluation_statistics(prediction),
        "threshold_summary": threshold_summary(prediction),
        "calibration_summary": calibration_summary(prediction),
        "prediction_distribution": prediction_distribution(prediction),
        "demographic_summary": demographic_summary(prediction),
    }


def diagnose_design(population: DataFrame, flagged_attrition: DataFrame) -> DataFrame:
    """Participant, predictor and outcome checks as (area, metric, value).

    The outcome-trend check reports the spread of yearly outcome rates.
    """
    y = (F.col("outcome_count") > 0).cast("double")
    base = population.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.countDistinct("subject_id").cast("double").alias("people"),
        F.sum(y).alias("outcomes"), (F.avg(y) * 100).alias("outcome_percent"), F.min("age_year").cast("double").alias("min_age"),
        F.max("age_year").cast("double").alias("max_age")).unpivot([], ["rows", "people", "outcomes", "outcome_percent", "min_age", "max_age"], "metric", "value")
    yearly = outcome_rate_trend(population).filter(F.col("aggregation") == "year").agg(
        F.min("outcome_percent").alias("lowest_year"), F.max("outcome_percent").alias("highest_year")
    ).unpivot([], ["lowest_year", "highest_year"], "metric", "value")
    steps = flagged_attrition.select(F.col("description").alias("metric"), F.col("target_count").cast("double").alias("value"))
    parts = (("participants", base), ("outcome_trend", yearly), ("attrition", steps))
    return reduce(DataFrame.unionByName, [f.withColumn("area", F.lit(c)) for c, f in parts])
