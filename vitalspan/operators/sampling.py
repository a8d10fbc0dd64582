"""Reproducible ordering and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.ranks import exclusive_sums, hash_order, order_bucket, row_ranks


def portable_order(person: str, date: str) -> Column:
    """Order key made of plain arithmetic on person id and calendar parts."""
    d = F.col(date)
    left = (F.col(person) * F.month(d)) % 123
    return left * ((F.year(d) * F.dayofmonth(d)).cast("long") % 123)


def take_ordered(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First n rows in order: each partition keeps n, then n of those. For
    short lists; samples of any size go through ``first_rows``."""
    return df.orderBy(*order).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the order of the given columns, for any n: only
    the rows up to the bucket that holds the n-th are numbered.

    ``order[0]`` is cut into order-preserving buckets and counted; the buckets
    before the n-th row are taken whole, the one with the n-th is ranked.
    """
    work = df.withColumn("_bucket", order_bucket(df, order[0]))
    counts = work.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = exclusive_sums(counts, [], "_bucket", ["_n"]).filter(F.col("_before_n") < n)
    placed = work.join(before.select("_bucket", "_n", "_before_n"), "_bucket")
    whole = F.col("_before_n") + F.col("_n") <= n
    # rows of the one bucket with the n-th row, ranked by all order columns in
    # ranges, so ties of the first do not meet in a task
    last = row_ranks(placed.filter(~whole), order, "_rank").filter(F.col("_before_n") + F.col("_rank") <= n)
    return placed.filter(whole).select(*df.columns).unionByName(last.select(*df.columns))


def stable_sample(df: DataFrame, person: str, date: str, n: int) -> DataFrame:
    """The same n rows on every run and engine; ties go by person and date."""
    keyed = df.withColumn("_key", portable_order(person, date))
    return first_rows(keyed, ["_key", person, date], n).drop("_key")


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order of a unique key; growing n keeps earlier rows."""
    hashed = df.withColumn("_h", hash_order(key, seed=seed))
    return first_rows(hashed, ["_h", key], n).drop("_h")
