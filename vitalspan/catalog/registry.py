"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.oracle import oracle
from vitalspan.session import configure_records
from vitalspan.sources.cdm import Cdm
from vitalspan.sources.derived import derived_cdm

_CASTS = {"l": "long", "f": "double", "d": "date", "s": "string", "b": "boolean", "t": "timestamp"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    plan: Callable[[Cdm], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(derived_cdm(configure_records(spark), folder))
        cols = []
        for name, kind in self.columns:
            c = F.col(name).cast(_CASTS[kind])
            cols.append((F.round(c, 6) + F.lit(0.0) if kind == "f" else c).alias(name))
        return df.select(*cols)


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a plan. ``columns`` lists ``name:kind`` with kinds l(ong)
    f(loat) d(ate) s(tring) b(oolean) t(imestamp)."""
    cols = tuple(tuple(c.split(":")) for c in columns.split())

    def register(plan: Callable[[Cdm], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, cols, plan, oracle(sql, list(cols), views) if sql else None)
        return plan

    return register
