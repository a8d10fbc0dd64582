"""Table access: queries, batches, loads, deletes and catalog listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.session import literal_frame, scratch_path


def jdbc_query(
    spark: SparkSession, url: str, sql: str, properties: dict[str, str] | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1,
) -> DataFrame:
    """Read a query over JDBC, split on a numeric column when one is given."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is None:
        return reader.option("query", sql).load()
    if bounds is None:
        raise ValueError("a partitioned read needs the column's bounds")
    lo, hi = bounds
    return (
        reader.option("dbtable", f"({sql}) q").option("partitionColumn", partition_column)
        .option("lowerBound", lo).option("upperBound", hi).option("numPartitions", partitions).load()
    )


def spill_query(spark: SparkSession, sql: str) -> DataFrame:
    """A result larger than memory, kept on executor disks while reused."""
    return spark.sql(sql).persist(StorageLevel.DISK_ONLY)


def param_query(spark: SparkSession, sql: str, args: dict) -> DataFrame:
    """Named parameter markers bound by Spark, never by string formatting."""
    return spark.sql(sql, args=args)


def param_vector_query(df: DataFrame, column: str, values: list) -> DataFrame:
    """One result set for a vector of parameter values."""
    kind = df.schema[column].dataType.simpleString()
    wanted = literal_frame(df.sparkSession, [(v,) for v in values], f"{column} {kind}").distinct()
    return df.join(wanted, column, "left_semi")


def batched_apply(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """Apply ``fn(pandas frame) -> pandas frame`` to every Arrow batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None and len(out):
                yield out

    return df.mapInPandas(run, schema)


def fetch_batches(df: DataFrame, rows: int) -> Iterator[list]:
    """Page a result through the driver, at most one partition at a time."""
    page: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        page.append(row)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page


def insert_table(df: DataFrame, path: str, create: bool = True) -> DataFrame:
    """Create (or append to) a Parquet table and return it."""
    df.write.mode("errorifexists" if create else "append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bulk_csv_load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Load (compressed) CSV with a header; blanks and empty fields are NULL."""
    raw = (
        spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(schema).csv(path)
    )
    return raw.select(*[
        F.when(F.trim(c) == "", F.lit(None)).otherwise(F.col(c)).alias(c)
        if isinstance(raw.schema[c].dataType, T.StringType) else F.col(c)
        for c in raw.columns
    ])


def delete_rows(df: DataFrame, where: str, args: dict, path: str | None = None) -> DataFrame:
    """Rewrite a table without the rows that satisfy ``where``.

    Rows for which the condition is NULL stay, as in SQL.
    """
    kept = df.sparkSession.sql(f"SELECT * FROM {{t}} WHERE NOT coalesce(({where}), false)", args=args, t=df)
    target = path or scratch_path(df.sparkSession, "after-delete")
    kept.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def list_tables(spark: SparkSession, pattern: str | None = None) -> list[str]:
    names = sorted(t.name for t in spark.catalog.listTables(pattern=pattern))
    return names


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
