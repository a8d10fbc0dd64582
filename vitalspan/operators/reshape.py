"""Reshaping wide and long frames, JSON columns, digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.operators.ranks import dense_ids, identify_runs


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def dcast(df: DataFrame, ids: list[str], variable: str, names: Sequence, agg: Column) -> DataFrame:
    """Long to wide; the column names are given, so no extra pass finds them."""
    return df.groupBy(*ids).pivot(variable, list(names)).agg(agg)


def add_margins(df: DataFrame, rows: str, variable: str, names: Sequence, measure: str) -> DataFrame:
    """Wide sums with row and column margins; margin rows are '(all)'."""
    both = df.select(F.col(rows).cast("string").alias(rows), F.col(variable).cast("string").alias(variable), measure)
    cube = both.cube(rows, variable).agg(
        F.sum(measure).alias("_v"), F.grouping(rows).alias("_gr"), F.grouping(variable).alias("_gv"))
    labelled = cube.select(
        F.when(F.col("_gr") == 1, "(all)").otherwise(F.col(rows)).alias(rows),
        F.when(F.col("_gv") == 1, "(all)").otherwise(F.col(variable)).alias("_var"), "_v")
    return labelled.groupBy(rows).pivot("_var", [*names, "(all)"]).agg(F.first("_v"))


def colsplit(df: DataFrame, column: str, pattern: str, names: Sequence[str]) -> DataFrame:
    parts = F.split(F.col(column), pattern, len(names))
    return df.select("*", *[parts.getItem(i).alias(n) for i, n in enumerate(names)])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to flat columns named ``outer<sep>inner``."""
    def walk(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*walk(df.schema, ()))


def json_rows(df: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """A JSON array of objects to rows; missing keys become NULL."""
    parsed = df.select(*keep, F.from_json(column, f"array<struct<{schema}>>").alias("_a"))
    return parsed.select(*keep, F.posexplode_outer("_a").alias("pos", "_o")).select(*keep, "pos", "_o.*")


def json_valid(column: str) -> Column:
    """Whether the text is one JSON value."""
    return F.get_json_object(F.col(column), "$").isNotNull()


def group_ids(df: DataFrame, column: str, name: str = "group_id") -> DataFrame:
    """Dense group number in value order, joined back from the distinct values."""
    return df.join(dense_ids(df, column, name), column)


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(run, value, length) of equal consecutive values."""
    runs = identify_runs(df, keys, order, value, "run_id")
    return runs.groupBy(*keys, "run_id").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))


def digest_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Row digests over the columns, NULL and empty text kept apart."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return {
        "md5": F.md5(text), "sha1": F.sha1(text), "sha256": F.sha2(text, 256), "crc32": F.crc32(text),
        "xxhash64": F.xxhash64(text),
    }


def duplicate_rows(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Exact-duplicate groups: digest, copies and the first id. Rows shuffle
    as (digest, id) only, after local pre-aggregation."""
    key = digest_columns(columns)["sha256"]
    return df.groupBy(key.alias("digest")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_id")).filter(F.col("copies") > 1)


def chop(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Split each group into chunks of at most ``size`` rows in order, so no
    list grows with the group."""
    from vitalspan.operators.ranks import row_numbers

    numbered = row_numbers(df, [key], [order], "_rn")
    return numbered.groupBy(key, F.expr(f"(_rn - 1) div {size}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.col(order))).alias("members"))


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("copy"))


def interleave(frames: Sequence[DataFrame], row_id: str) -> DataFrame:
    """Rows of several frames with a position that alternates between them."""
    k = len(frames)
    tagged = [f.withColumn("position", F.col(row_id) * k + i) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged)
