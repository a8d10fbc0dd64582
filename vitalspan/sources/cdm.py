"""A lazily built set of record tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalspan.session import materialize, size_shuffles
from vitalspan.sources.schemas import LAYOUTS, conform


class Cdm:
    """Record tables by attribute name; each frame is planned on first use."""

    def __init__(self, spark: SparkSession, builders: dict[str, Callable[["Cdm"], DataFrame]]):
        self.spark = spark
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._builders[name](self)
        return self._frames[name]

    def pin(self, *names: str) -> "Cdm":
        """Write tables that one job uses several times and read them back."""
        for name in names:
            self._frames[name] = materialize(getattr(self, name), name)
        return self

    def tables(self) -> list[str]:
        return sorted(self._builders)


def load_cdm(spark: SparkSession, location: str, fmt: str = "parquet") -> Cdm:
    """Read the record tables under a folder, or from a catalog schema when
    ``fmt`` is ``"table"``."""

    def reader(table: str) -> Callable[[Cdm], DataFrame]:
        def build(_: Cdm) -> DataFrame:
            if fmt == "table":
                return conform(spark.table(f"{location}.{table}"), table)
            frame = conform(spark.read.format(fmt).load(f"{location}/{table}"), table)
            size_shuffles(spark, f"{location}/{table}")
            return frame

        return build

    return Cdm(spark, {table: reader(table) for table in LAYOUTS})
