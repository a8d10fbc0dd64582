"""Row predicates shared by the plans."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import col
from vitalspan.session import literal_frame

INLINE_LIST_LIMIT = 1000


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def is_mapped(concept: Column | str) -> Column:
    return col(concept) != 0


def supply_not_negative(days_supply: Column | str) -> Column:
    return F.coalesce(col(days_supply), F.lit(0)) >= 0


def name_contains_any(name, parts: Iterable[str]) -> Column:
    lowered = F.lower(col(name))
    return any_of(lowered.contains(p.lower()) for p in parts)


def code_prefix_any(code, prefixes: Iterable[str]) -> Column:
    raised = F.upper(col(code))
    return any_of(raised.startswith(p.upper()) for p in prefixes)


def name_like_none(name, patterns: Iterable[str]) -> Column:
    return all_of(~col(name).like(p) for p in patterns)


def ratio_to_limit(value, limit) -> Column:
    """value / limit, NULL when the limit is missing or zero."""
    return col(value) / F.nullif(col(limit), F.lit(0.0))


def compare(left: Column, op: str, right) -> Column:
    return {
        ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right,
        "=": left == right, "!=": left != right,
    }[op]


def range_group(value, low, high) -> Column:
    """1 below, 2 within, 3 above the normal range."""
    return F.when(col(value) < col(low), 1).when(col(value) > col(high), 3).otherwise(2)


def filter_concepts(df: DataFrame, column: str, ids: Iterable[int], keep: bool = True) -> DataFrame:
    """Keep or drop rows by concept id: a literal list while it is short, a
    semi or anti join against an id table beyond that."""
    ids = sorted(set(ids))
    if len(ids) <= INLINE_LIST_LIMIT:
        test = F.col(column).isin(ids) if ids else F.lit(False)
        return df.filter(test if keep else ~test)
    table = literal_frame(df.sparkSession, [(i,) for i in ids], f"{column} long")
    return df.join(table, column, "left_semi" if keep else "left_anti")
