"""Exact nearest neighbours by an inverted index.

Of training rows with equal vectors the k first are kept, as postings: per
covariate its holders, each with its value and squared length. A test row is first compared with the k shortest
training rows and with the k shortest holders of each of its covariates, which
gives a distance that at least k rows reach. Its covariates are then walked
from the rarest: a training row that shares only those from some point on has
a product with the test row of at most their values times the largest ones
known, so its distance has a lower bound by its length. Where that bound passes
the known distance for every holder the posting is not read, which spares the
commonest ones; of the others only holders of fitting length are met. Survivors
get their exact distance.

Where the postings to read come to a good part of all pairs, as with few and
common covariates, meeting holders one by one costs more than comparing all:
test and training rows are then dealt into blocks of bounded size, and each
pair of blocks walks its postings into one matrix of products. Of each block a
test row keeps the k nearest within the known distance.

Values must be zero or more, as flags, counts and scaled values are; others
raise. Distances are Euclidean, of equal ones the smaller row id is nearer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.sampling import take_ordered
from vitalspan.session import materialize, share_code

#: Slack for bounds, against rounding.
SLACK = 1e-7
#: Test and training rows of a block; their products are one matrix in a task.
TEST_ROWS, TRAINING_ROWS = 2048, 4096
#: Postings to read, as a part of all pairs, from which blocks are compared.
COMMON = 1 / 64


def _entries(covariates: DataFrame, rows: DataFrame) -> DataFrame:
    kept = covariates.join(rows.select("row_id"), "row_id", "left_semi")
    value = F.sum(F.col("covariate_value").cast("double"))
    checked = F.when(value < 0, F.raise_error(F.lit("nearest neighbours need values of zero or more"))).otherwise(value)
    return kept.groupBy("row_id", "covariate_id").agg(checked.cast("double").alias("v")).filter("v <> 0")


def _vectors(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row id with its sorted covariates and its squared length."""
    listed = entries.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("covariate_id", "v"))).alias("e"))
    empty = F.array().cast("array<struct<covariate_id:bigint,v:double>>")
    rows = rows.join(listed, "row_id", "left").withColumn("e", F.coalesce("e", empty))
    # summed in one order, so that equal vectors have equal lengths
    return rows.withColumn("n2", F.aggregate("e", F.lit(0.0), lambda s, x: s + x["v"] * x["v"]))


def _postings(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and values of the holders of each covariate, covariates rising."""
    e = rows.column("e").combine_chunks()
    places = np.repeat(np.arange(len(e)), pc.list_value_length(e).to_numpy())
    covariate, value = (c.to_numpy() for c in e.flatten().flatten())
    order = np.argsort(covariate, kind="stable")
    names, starts = np.unique(covariate[order], return_index=True)
    return dict(zip(names.tolist(), zip(np.split(places[order], starts[1:]), np.split(value[order], starts[1:]), strict=True), strict=True)) if len(names) else {}


def _closest(k: int):
    def work(test: pa.Table, training: pa.Table) -> pa.Table:
        """``row_id, neighbour`` of the k training rows nearest to each test
        row, as far as they come before the last one known."""
        left, right = _postings(test), _postings(training)
        dot = np.zeros((len(test), len(training)))
        for c, (at, v) in left.items():
            if c in right:
                there, w = right[c]
                dot[np.ix_(at, there)] += np.outer(v, w)
        length, other, reach, last, row, ids = (
            t.column(n).to_numpy() for t, n in ((test, "n2"), (training, "n2"), (test, "reach"), (test, "last"), (test, "row_id"), (training, "neighbour")))
        dot *= -2
        dot += length[:, None] + other[None, :]
        a, b = np.nonzero(dot <= (reach + SLACK)[:, None])
        far, name = np.round(np.maximum(dot[a, b], 0), 9), ids[b]
        nearer = (far < reach[a] - 1e-10) | (name < last[a])
        a, far, name = a[nearer], far[nearer], name[nearer]
        order = np.lexsort((name, far, a))
        a, name = a[order], name[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        return pa.table([pa.array(row[a[rank < k]], pa.int64()), pa.array(name[rank < k], pa.int64())], names=["row_id", "neighbour"])
    return work


@dataclass
class NeighbourModel:
    """Postings (covariate_id, neighbour, v, n2), the vectors behind them, and
    per covariate its frequency, largest value and shortest holder."""

    vectors: DataFrame
    postings: DataFrame
    statistics: DataFrame
    champions: DataFrame
    shortest: list[int]
    k: int

    def _distances(self, pairs: DataFrame, test: DataFrame) -> DataFrame:
        left = test.select("row_id", F.col("e").alias("_a"), F.col("n2").alias("_na"))
        right = self.vectors.select(F.col("row_id").alias("neighbour"), F.map_from_entries("e").alias("_b"), F.col("n2").alias("_nb"), "label")
        joined = pairs.join(left, "row_id").join(right, "neighbour")
        dot = F.aggregate(
            F.col("_a"), F.lit(0.0), lambda s, x: s + x["v"] * F.coalesce(F.try_element_at("_b", x["covariate_id"]), F.lit(0.0)))
        far = F.round(F.greatest(F.col("_na") + F.col("_nb") - 2 * dot, F.lit(0.0)), 9)
        return joined.select("row_id", "neighbour", "label", far.alias("distance"))

    def _nearest(self, distances: DataFrame) -> DataFrame:
        """The k nearest of each row, cut before the shuffle and after it."""
        order = Window.partitionBy("row_id").orderBy("distance", "neighbour")
        return distances.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= self.k)

    def neighbours(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        """``row_id, neighbour, label, distance`` of the k nearest training
        rows; distances leave out covariates no training row has. Test rows
        with equal vectors are looked up once."""
        rows = population.select("row_id").distinct()
        every = _vectors(rows, _entries(covariates, rows).join(self.statistics.select("covariate_id"), "covariate_id"))
        every = materialize(every, "every")
        test = materialize(every.groupBy("e").agg(F.min("row_id").alias("row_id"), F.first("n2").alias("n2")), "test")
        found = self._search(test).withColumnRenamed("row_id", "_one")
        same = every.select("row_id", "e").join(test.select("e", F.col("row_id").alias("_one")), "e").select("row_id", "_one")
        return same.join(found, "_one").drop("_one")

    def _search(self, test: DataFrame) -> DataFrame:
        mine = test.select("row_id", F.explode("e").alias("_x")).select("row_id", "_x.*").join(self.statistics, "covariate_id")
        mine, rows = materialize(mine, "entries"), test.select("row_id")
        near = mine.select("row_id", "covariate_id").join(self.champions, "covariate_id").select("row_id", "neighbour")
        short = rows.select("row_id", F.explode(F.lit(self.shortest).cast("array<bigint>")).alias("neighbour"))
        first = materialize(self._distances(near.unionByName(short).distinct(), test), "first")
        reached = self._nearest(first).groupBy("row_id").agg(F.max(F.struct("distance", "neighbour")).alias("_f")).select(
            "row_id", F.col("_f.distance").alias("reach"), F.col("_f.neighbour").alias("last"))
        # training rows that share nothing before a covariate: their product with
        # the row is at most _w and at most _a times their length
        onwards = Window.partitionBy("row_id").orderBy("frequency", "covariate_id").rowsBetween(0, Window.unboundedFollowing)
        held = mine.select("row_id", "covariate_id", "frequency", "least", F.sqrt(F.sum(F.col("v") * F.col("v")).over(onwards)).alias("_a"),
                           F.sum(F.col("v") * F.col("peak")).over(onwards).alias("_w"))
        held = held.join(reached, "row_id").join(test.select("row_id", F.col("n2").alias("_n2")), "row_id")

        def at_least(length):
            return F.col("_n2") + length * length - 2 * F.least(F.col("_a") * length, F.col("_w"))

        shortest = F.greatest(F.least(F.col("_a"), F.col("_w") / F.col("_a")), F.sqrt("least"))
        walked = materialize(held.filter(at_least(shortest) <= F.col("reach") + SLACK), "walked")
        read, n, m = walked.agg(F.sum("frequency")).first()[0] or 0, test.count(), self.vectors.count()
        if read > COMMON * n * m:
            met = self._met_in_blocks(test.join(reached, "row_id"), n, m)
        else:
            met = self._met_one_by_one(walked, at_least)
        more = met.join(first.select("row_id", "neighbour"), ["row_id", "neighbour"], "left_anti")
        return self._nearest(self._distances(more, test).unionByName(first)).drop("_r")

    def _met_one_by_one(self, walked: DataFrame, at_least) -> DataFrame:
        """Pairs that share a walked covariate, as far as lengths allow."""
        # distances have nine digits, so what cannot be nearer than the last row must come before it
        met = walked.join(self.postings, "covariate_id").withColumn("_far", at_least(F.sqrt("n2"))).filter(
            (F.col("_far") <= F.col("reach") + SLACK) & ((F.col("_far") < F.col("reach") - 1e-10) | (F.col("neighbour") < F.col("last"))))
        return met.select("row_id", "neighbour").distinct()

    def _met_in_blocks(self, test: DataFrame, n: int, m: int) -> DataFrame:
        """Of each block of training rows the nearest to each test row, from
        all ``n * m`` pairs."""
        share_code(test.sparkSession)
        across, down = -(-n // TEST_ROWS), -(-m // TRAINING_ROWS)

        def dealt(rows: DataFrame, key: str, blocks: int, own: str, others: int, other: str, *columns: str) -> DataFrame:
            return rows.where(F.col(key).isNotNull()).select(key, "e", "n2", *columns, F.pmod(F.xxhash64(key), F.lit(blocks)).alias(own),
                               F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).groupBy("i", "j")

        left = dealt(test, "row_id", across, "i", down, "j", "reach", "last")
        # rows of one id have one vector; their copies come back with its distances
        right = dealt(self.vectors.dropDuplicates(["row_id"]).withColumnRenamed("row_id", "neighbour"), "neighbour", down, "j", across, "i")
        return left.cogroup(right).applyInArrow(_closest(self.k), "row_id long, neighbour long")

    def predict(self, covariates: DataFrame, population: DataFrame) -> DataFrame:
        """Share of outcomes among the k nearest training rows."""
        vote = self.neighbours(covariates, population).groupBy("row_id").agg(F.avg("label").alias("value"))
        return population.join(vote, "row_id")


def fit_knn(covariates: DataFrame, population: DataFrame, k: int = 10) -> NeighbourModel:
    rows = population.select("row_id", (F.col("outcome_count") > 0).cast("double").alias("label"))
    entries = materialize(_entries(covariates, rows), "entries")
    # of equal vectors only the k first rows can be among the nearest
    alike = Window.partitionBy("e").orderBy("row_id")
    vectors = materialize(_vectors(rows, entries).withColumn("_r", F.row_number().over(alike)).filter(F.col("_r") <= k).drop("_r"), "vectors")
    held = vectors.select(F.col("row_id").alias("neighbour"), "n2", F.explode("e").alias("_x"))
    postings = materialize(held.select("_x.covariate_id", "neighbour", "_x.v", "n2"), "postings")
    statistics = materialize(postings.groupBy("covariate_id").agg(F.count(F.lit(1)).alias("frequency"), F.max("v").alias("peak"), F.min("n2").alias("least")), "statistics")
    order = Window.partitionBy("covariate_id").orderBy("n2", "neighbour")
    champions = materialize(postings.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("covariate_id", "neighbour"), "champions")
    shortest = [r.row_id for r in take_ordered(vectors.select("row_id", "n2"), ["n2", "row_id"], k).collect()]
    return NeighbourModel(vectors, postings, statistics, champions, shortest, k)
