"""Feature preparation between sparse covariates and the learners."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.operators.ranks import dense_ids
from vitalspan.operators.sampling import take_ordered
from vitalspan.session import scratch_path

def map_ids(covariates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense row and covariate numbers from 1, in id order."""
    return dense_ids(covariates, "row_id", "new_row_id"), dense_ids(covariates, "covariate_id", "new_covariate_id")


def feature_index(covariates: DataFrame) -> DataFrame:
    """(covariate_id, idx from 0)."""
    return dense_ids(covariates, "covariate_id", "_n").select("covariate_id", (F.col("_n") - 1).cast("int").alias("idx"))


def _as_vectors(rows: DataFrame, size: int) -> DataFrame:
    """(row_id, features) from (row_id, sorted entries ``_e``).

    The entries are written in the struct that vectors are stored as and read
    back with the vector type: no Python function packs rows.
    """
    spark = rows.sparkSession
    stored = rows.select("row_id", F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
        F.transform("_e", lambda e: e["idx"]).alias("indices"), F.transform("_e", lambda e: e["v"]).alias("values")).alias("features"))
    path = scratch_path(spark, "vectors")
    stored.write.parquet(path)
    return spark.read.schema(T.StructType([rows.schema["row_id"], T.StructField("features", VectorUDT())])).parquet(path)


def to_vectors(covariates: DataFrame, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_id, features) and the feature index. Pass the training index to
    lay out new data the same way; covariates it lacks are dropped.

    Vectors are sparse whatever the number of features; a row's list is
    bounded by that number.
    """
    index = feature_index(covariates) if index is None else index
    size = index.count()
    entries = covariates.join(index, "covariate_id").groupBy("row_id", "idx").agg(
        F.sum(F.col("covariate_value").cast("double")).alias("v"))
    rows = entries.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("_e"))
    return _as_vectors(rows, size), index


def select_univariate(covariates: DataFrame, population: DataFrame, k: int) -> DataFrame:
    """Top-k covariates by the chi-square statistic of presence and outcome."""
    y = (F.col("outcome_count") > 0).cast("long")
    totals = population.agg(F.count(F.lit(1)).cast("double").alias("t"), F.sum(y).cast("double").alias("p"))
    t, p = totals.select("t").scalar(), totals.select("p").scalar()
    hits = covariates.join(population.select("row_id", y.alias("_y")), "row_id").groupBy("covariate_id").agg(
        F.count(F.lit(1)).cast("double").alias("a1"), F.sum("_y").cast("double").alias("a"))
    hits = hits.withColumn("t", t).withColumn("p", p)
    a, a1, t, p = (F.col(c) for c in ("a", "a1", "t", "p"))
    cross = a * ((t - a1) - (p - a)) - (a1 - a) * (p - a)
    scored = hits.select(
        "covariate_id", (t * cross * cross / F.nullif(a1 * (t - a1) * p * (t - p), F.lit(0.0))).alias("statistic"))
    return take_ordered(scored, [F.round("statistic", 9).desc_nulls_last(), "covariate_id"], k)


def select_random_forest(train: DataFrame, index: DataFrame, trees: int = 20, depth: int = 4, seed: int = 1) -> DataFrame:
    """Covariates a random forest uses, with their importance."""
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    return importance_table(model, index).filter(F.col("importance") > 0)


def importance_table(model, index: DataFrame) -> DataFrame:
    """Feature importances of a tree model by covariate id."""
    weights = F.lit([float(v) for v in model.featureImportances.toArray()])
    return index.select("covariate_id", F.element_at(weights, F.col("idx") + 1).alias("importance"))


SPLINE_KNOTS = (0.0, 0.05, 0.275, 0.5, 0.775, 0.95, 1.0)


def spline_basis(x, knots: Sequence[float]) -> list:
    """Restricted cubic spline basis: linear beyond the outer knots."""
    k = list(dict.fromkeys(float(v) for v in knots))
    last, before = k[-1], k[-2]
    scale = (last - k[0]) ** 2

    def cube(c):
        return F.pow(F.greatest(x - F.lit(c), F.lit(0.0)), F.lit(3.0))

    out = [x]
    for t in k[:-2]:
        out.append((cube(t) - cube(before) * (last - t) / (last - before) + cube(last) * (before - t) / (last - before)) / scale)
    return out


def least_squares(df: DataFrame, columns: list, y) -> list[float]:
    """Coefficients (intercept first) from the cross products, one aggregation."""
    terms = [F.lit(1.0), *columns]
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(n) for j in range(i, n)] + [F.sum(t * y) for t in terms]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    xtx, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            xtx[i, j] = xtx[j, i] = row[at]
            at += 1
    xty = np.array([row[at + i] for i in range(n)], dtype=float)
    return [float(v) for v in np.linalg.lstsq(xtx, xty, rcond=None)[0]]


def age_spline(population: DataFrame, covariate_id: int = 2002) -> tuple[DataFrame, list[float], list[float]]:
    """Fitted outcome risk by a spline of age as a new covariate; returns it
    with the knots and coefficients for use on new data."""
    x = F.col("age_year").cast("double")
    ages = population.groupBy(x.alias("a")).agg(F.count(F.lit(1)).alias("n"))
    knots = ages.agg(F.percentile("a", list(SPLINE_KNOTS), F.col("n"))).first()[0]
    basis = spline_basis(x, knots)
    beta = least_squares(population, basis, (F.col("outcome_count") > 0).cast("double"))
    return apply_spline(population, knots, beta, covariate_id), list(knots), beta


def apply_spline(population: DataFrame, knots: Sequence[float], beta: Sequence[float], covariate_id: int = 2002) -> DataFrame:
    fitted = F.lit(beta[0])
    for b, term in zip(beta[1:], spline_basis(F.col("age_year").cast("double"), knots), strict=True):
        fitted = fitted + F.lit(b) * term
    return population.select("row_id", F.lit(covariate_id).cast("long").alias("covariate_id"), fitted.alias("covariate_value"))


def discretise_age(population: DataFrame, old_after: int = 30) -> DataFrame:
    return population.select(
        "row_id", F.round(F.col("age_year") / 10).cast("long").alias("decade"), (F.col("age_year") > old_after).alias("old"))


def one_hot(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Factor columns to one sparse design matrix, every level kept."""
    stages = []
    for c in columns:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_i", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", dropLast=False))
    stages.append(VectorAssembler(inputCols=[f"{c}_v" for c in columns], outputCol="features"))
    model = Pipeline(stages=stages).fit(df)
    names = [f"{c}={level}" for i, c in enumerate(columns) for level in model.stages[2 * i].labels]
    return model.transform(df), names


def chi_square(population: DataFrame, features: list[str]) -> DataFrame:
    """Chi-square statistic of each feature and the outcome, from counts."""
    y = (F.col("outcome_count") > 0).cast("int").alias("y")
    long = population.select(y, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])).alias("s"))
    cells = long.groupBy("s.feature", "s.level", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy("feature", "level").agg(F.sum("n").alias("rn"))
    cols = cells.groupBy("feature", "y").agg(F.sum("n").alias("kn"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("tn"))
    full = rows.join(cols, "feature").join(total, "feature").join(cells, ["feature", "level", "y"], "left")
    expected = F.col("rn") * F.col("kn") / F.col("tn")
    gap = F.coalesce("n", F.lit(0.0)) - expected
    return full.groupBy("feature").agg(
        F.sum(gap * gap / expected).alias("statistic"),
        ((F.countDistinct("level") - 1) * (F.countDistinct("y") - 1)).alias("degrees"))
