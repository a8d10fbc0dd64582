"""Set operations and vector-style helpers on frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.ranks import first_per_key


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Duplicates go before and after the union, so each side shuffles once reduced."""
    return union_all([f.distinct() for f in frames]).distinct()


def bind_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with different columns; absent ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def value_tally(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values with counts and a duplicate marker."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("duplicated", F.col("n") > 1)


def duplicate_first_id(df: DataFrame, columns: list[str], row_id: str, name: str = "first_id") -> DataFrame:
    """For each row the id of the first row with equal values. The reduced
    side has one row per value, so hot values join as a small table."""
    first = df.groupBy(*columns).agg(F.min(row_id).alias(name))
    return df.join(first, columns)


def match_first(needles: DataFrame, haystack: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Left join to the first matching row only."""
    return needles.join(first_per_key(haystack, columns, order), columns, "left")


def locate_matches(needles: DataFrame, haystack: DataFrame, columns: list[str], at_most: tuple[str, str]) -> DataFrame:
    """All matches on equal columns where a needle column is at most a
    haystack column."""
    a, b = at_most
    return needles.join(haystack, columns).filter(F.col(a) <= F.col(b))
