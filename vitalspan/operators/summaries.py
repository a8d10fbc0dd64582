"""Exact distribution summaries by cumulative counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.ranks import running_totals
from vitalspan.session import materialize

QUANTILES = (("median_value", 0.50), ("p10_value", 0.10), ("p25_value", 0.25), ("p75_value", 0.75), ("p90_value", 0.90))
SUMMARY_COLUMNS = [
    "count_value", "min_value", "max_value", "average_value", "standard_deviation",
    "median_value", "p10_value", "p25_value", "p75_value", "p90_value",
]


def sample_sd(value: Column) -> Column:
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


def value_counts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return values.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def continuous_summary(
    values: DataFrame, population: DataFrame, keys: list[str], pop_keys: list[str], value: str = "value",
) -> DataFrame:
    """Distribution over the whole population where a missing value counts as
    zero. ``population`` has one row per ``pop_keys`` with ``population_size``.

    Mean divides by the population, sd uses only rows with a value, min is 0
    unless everyone has a value.
    """
    counts = value_counts(values, keys, value)
    x, n = F.col("value").cast("double"), F.col("n")
    stats = counts.groupBy(*keys).agg(
        F.sum(n).alias("count_value"), F.min(x).alias("_min"), F.max(x).alias("max_value"),
        F.sum(n * x).alias("_s1"), F.sum(n * x * x).alias("_s2"),
    ).join(population, pop_keys)
    cnt, size = F.col("count_value"), F.col("population_size")
    sd = F.sqrt((cnt * F.col("_s2") - F.col("_s1") * F.col("_s1")) / (cnt * (cnt - 1.0)))
    stats = stats.select(
        *keys, "count_value", F.when(cnt == size, F.col("_min")).otherwise(0.0).alias("min_value"), "max_value",
        (F.col("_s1") / size).alias("average_value"), F.when(cnt == 1, 0.0).otherwise(sd).alias("standard_deviation"),
        (size - cnt).alias("count_no_value"), "population_size",
    )
    cumulative = running_totals(counts, keys, "value", ["n"]).join(stats, keys)
    return _quantiles(cumulative, keys, "count_no_value", "population_size")


def nonmissing_summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The same statistics over the rows that have a value."""
    stats = values.groupBy(*keys).agg(
        F.count(value).alias("count_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.avg(value).alias("average_value"), sample_sd(F.col(value)).alias("standard_deviation"),
    ).withColumn("count_no_value", F.lit(0)).withColumn("population_size", F.col("count_value"))
    cumulative = running_totals(value_counts(values, keys, value), keys, "value", ["n"]).join(stats, keys)
    return _quantiles(cumulative, keys, "count_no_value", "population_size")


def _quantiles(cumulative: DataFrame, keys: list[str], missing: str, size: str) -> DataFrame:
    reach = F.col("cum_n") + F.col(missing)
    picks = []
    for name, q in QUANTILES:
        target = F.lit(q) * F.col(size)
        smallest = F.min(F.when(reach >= target, F.col("value").cast("double")))
        picks.append(smallest.alias(name))
    fixed = ["count_value", "min_value", "max_value", "average_value", "standard_deviation", missing, size]
    out = cumulative.groupBy(*keys).agg(*[F.first(c).alias(c) for c in fixed], *picks)
    zero = [
        F.when(F.lit(q) * F.col(size) < F.col(missing), F.lit(0.0)).otherwise(F.col(n)).alias(n) for n, q in QUANTILES
    ]
    return out.select(*keys, *fixed[:5], *zero)


def discrete_percentiles(values: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Smallest value whose cumulative count reaches q times the count."""
    counts = value_counts(values.filter(F.col(value).isNotNull()), keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total")) if keys else None
    cum = running_totals(counts, keys, "value", ["n"])
    if keys:
        cum = cum.join(totals, keys)
    else:
        cum = cum.withColumn("_total", counts.agg(F.sum("n")).scalar())
    return cum.groupBy(*keys).agg(
        *[F.min(F.when(F.col("cum_n") >= F.lit(q) * F.col("_total"), F.col("value"))).alias(n)
          for n, q in quantiles.items()])


#: Rows of a group up to which one task orders them.
GROUP_ROWS = 1 << 20


def middle_value(values: DataFrame, keys: list[str], value: str, alias: str, weight: str | None = None) -> DataFrame:
    """Interpolating median from grouped values (mean of the two middle ones).
    ``weight`` names a column with the number of repeats of a row."""
    return middle_values(values, keys, {alias: value}, weight)


def middle_values(values: DataFrame, keys: list[str], columns: dict[str, str], weight: str | None = None) -> DataFrame:
    """Medians of several columns (name -> column) of the keys that have a
    value in each of them.

    The rows are written and shuffled once by key; each column is ordered where
    its rows then are. Groups of more than ``GROUP_ROWS`` rows are ranked in
    value buckets instead, one column after the other.
    """
    repeats = F.col(weight) if weight else F.lit(1)
    named = values.select(*keys, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns.values())], repeats.alias("_n"))
    if not keys:
        return _middle_by_buckets(named, keys, list(columns))
    rows = materialize(_known(named, keys), "values")
    large = materialize(rows.groupBy(*keys).count().filter(F.col("count") > GROUP_ROWS).drop("count"), "large")
    if large.isEmpty():
        return _middle_in_order(rows, keys, list(columns))
    few = _middle_in_order(rows.join(large, keys, "left_anti"), keys, list(columns))
    return few.unionByName(_middle_by_buckets(rows.join(large, keys, "left_semi"), keys, list(columns)))


def _known(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.filter(reduce(Column.__and__, [F.col(n).isNotNull() for n in names]))


def _between(value: Column, reach: Column, total: Column) -> Column:
    """Mean of the first value that reaches half of the total and the first
    that exceeds it."""
    half = total / 2.0
    return (F.min(F.when(reach >= half, value)) + F.min(F.when(reach > half, value))) / 2.0


def _middle_in_order(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    placed = rows
    for i in range(len(names)):
        v = F.col(f"_v{i}")
        mine = F.sum(F.when(v.isNotNull(), F.col("_n")).otherwise(0))
        ordered = Window.partitionBy(*keys).orderBy(v)
        placed = placed.withColumns({
            f"_r{i}": mine.over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            f"_t{i}": mine.over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    middles = [_between(F.col(f"_v{i}"), F.col(f"_r{i}"), F.col(f"_t{i}")).alias(n) for i, n in enumerate(names)]
    return _known(placed.groupBy(*keys).agg(*middles), names)


def _middle_by_buckets(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    out = None
    for i, name in enumerate(names):
        present = rows.filter(F.col(f"_v{i}").isNotNull())
        counts = present.groupBy(*keys, F.col(f"_v{i}").alias("value")).agg(F.sum("_n").alias("n"))
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
        cum = running_totals(counts, keys, "value", ["n"])
        cum = cum.join(totals, keys) if keys else cum.crossJoin(totals)
        found = cum.groupBy(*keys).agg(_between(F.col("value"), F.col("cum_n"), F.col("_total")).alias(name))
        out = found if out is None else out.join(found, keys) if keys else out.crossJoin(found)
    return out
