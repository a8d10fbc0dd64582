"""Ranks and running values that never put a whole group into one task.

The order column is cut into buckets by a monotone function of the value
itself. Totals per bucket give each bucket's offset; the sort then runs inside
single buckets. Being a pure function of the row, a bucket is the same on
every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.session import materialize

_RESOLUTION = 2048.0
_CENTRE = 1 << 21
_RUN_BITS = 12
_STEP_BITS = 14


def order_bucket(df: DataFrame, name: str) -> Column:
    """A coarse, order-preserving bucket of a column.

    Whole numbers: runs of 4,096 values, wherever they start. Other numbers:
    logarithmic steps of 1/2048 on both sides of zero. Dates: the day.
    Timestamps: the minute. Strings: the first four characters, which is
    balanced for hex digests; ``row_ranks`` and ``dense_ids`` cut other text
    into sampled ranges.
    """
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.IntegralType):
        # nulls come first
        return F.coalesce(F.shiftright(c.cast("long"), _RUN_BITS), F.lit(-(2**60)))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(c.cast("timestamp")) / 60).cast("long")
    if isinstance(kind, T.StringType):
        return F.substring(c, 1, 4)
    x = c.cast("double")
    # Clamped so that infinities stay in range; nulls sort first and NaN last.
    step = lambda v: F.floor(F.least(F.log(v) * F.lit(_RESOLUTION), F.lit(1.6e6))) + F.lit(_CENTRE)
    return (
        F.when(x.isNull(), -2 * _CENTRE).when(F.isnan(x), 2 * _CENTRE).when(x > 0, step(x)).when(x < 0, -step(-x))
        .otherwise(0).cast("long"))


def _part(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def exclusive_sums(frame: DataFrame, keys: list[str], by: str, measures: list[str]) -> DataFrame:
    """Add ``_before<m>``: the sum of a measure over all earlier buckets of the
    key. ``frame`` holds one row per (keys, by).

    Numbered buckets are summed in three levels of 16,384 each, so that a
    table of many buckets is never ordered in one task; other buckets (digest
    prefixes) are few by construction.
    """
    def before(part: list[str], order: str):
        return _part(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def summed(f: DataFrame, part: list[str], order: str, tag: str) -> DataFrame:
        return f.withColumns({f"{tag}{m}": F.coalesce(F.sum(m).over(before(part, order)), F.lit(0)) for m in measures})

    if not isinstance(frame.schema[by].dataType, T.IntegralType):
        return summed(frame, keys, by, "_before")
    f = frame.withColumn("_g1", F.shiftright(F.col(by).cast("long"), _STEP_BITS)).withColumn("_g2", F.shiftright("_g1", _STEP_BITS))
    totals = [F.sum(m).alias(m) for m in measures]
    middle = f.groupBy(*keys, "_g2", "_g1").agg(*totals)
    upper = middle.groupBy(*keys, "_g2").agg(*totals)
    middle = summed(middle, [*keys, "_g2"], "_g1", "_m1").drop(*measures)
    upper = summed(upper, list(keys), "_g2", "_m2").drop(*measures)
    f = summed(f, [*keys, "_g1"], by, "_m0")
    null_safe = middle.join(upper, [*keys, "_g2"]).drop("_g2")
    out = f.drop("_g2").join(null_safe, [*keys, "_g1"])
    return out.select(*frame.columns, *[(F.col(f"_m0{m}") + F.col(f"_m1{m}") + F.col(f"_m2{m}")).alias(f"_before{m}") for m in measures])


def running_totals(
    df: DataFrame, keys: list[str], value: str, measures: list[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_<m>``: the sum over all rows of the key up to and including
    this value. ``df`` holds one row per (keys, value)."""
    b = df.withColumn("_b", order_bucket(df, value))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    if descending and isinstance(totals.schema["_b"].dataType, T.IntegralType):
        totals, b = totals.withColumn("_b", -F.col("_b")), b.withColumn("_b", -F.col("_b"))
    if descending and isinstance(totals.schema["_b"].dataType, T.StringType):
        before = _part(keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *keys, "_b", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures])
    else:
        offsets = exclusive_sums(totals, keys, "_b", [f"_t_{m}" for m in measures]).select(
            *keys, "_b", *[F.col(f"_before_t_{m}").alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(*keys, "_b").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = b.select("*", *[F.sum(m).over(inside).alias(f"_i_{m}") for m in measures]).join(offsets, [*keys, "_b"])
    return out.select(
        *df.columns, *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` in two levels.

    The last order column breaks ties. Leading order columns are handled by
    exact value, so they may hold heavy ties; the last one is cut into buckets.
    """
    lead, last = order[:-1], order[-1]
    cols = df.columns
    work = df.withColumn("_b_last", order_bucket(df, last))
    if len(lead) > 1:
        raise ValueError("at most one leading order column")
    cell_keys = list(keys)
    if lead:
        work = work.withColumn("_b_lead", order_bucket(df, lead[0]))
        cell_keys += ["_b_lead", lead[0]]
    cells = work.groupBy(*cell_keys, "_b_last").agg(F.count(F.lit(1)).alias("_n"))

    def offset(frame: DataFrame, part: list[str], by: str, alias: str) -> DataFrame:
        if by.startswith("_b_"):
            return exclusive_sums(frame, part, by, ["_n"]).withColumnRenamed("_before_n", alias)
        before = _part(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn(alias, F.coalesce(F.sum("_n").over(before), F.lit(0)))

    placed = offset(cells, cell_keys, "_b_last", "_off0").drop("_n")
    total = F.col("_off0")
    if lead:
        by_value = cells.groupBy(*cell_keys).agg(F.sum("_n").alias("_n"))
        by_bucket = by_value.groupBy(*keys, "_b_lead").agg(F.sum("_n").alias("_n"))
        values = offset(by_value, [*keys, "_b_lead"], lead[0], "_off1").drop("_n")
        buckets = offset(by_bucket, list(keys), "_b_lead", "_off2").drop("_n")
        placed = placed.join(values, cell_keys).join(buckets, [*keys, "_b_lead"])
        total = total + F.col("_off1") + F.col("_off2")
    placed = placed.select(*cell_keys, "_b_last", total.alias("_off"))
    local = Window.partitionBy(*cell_keys, "_b_last").orderBy(last)
    numbered = work.withColumn("_rn", F.row_number().over(local))
    return numbered.join(placed, [*cell_keys, "_b_last"]).select(
        *cols, (F.col("_rn") + F.col("_off")).cast("long").alias(name))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, dense id from 1) for the distinct values, in value order."""
    values = df.select(column).distinct()
    if isinstance(df.schema[column].dataType, T.StringType):
        return _range_numbers(values, column, name)
    return row_numbers(values, [], [column], name)


def _range_numbers(values: DataFrame, column: str, name: str) -> DataFrame:
    return row_ranks(values, [column], name).select(column, name)


def row_ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 over all rows, for order columns of any shape:
    range-partition, write the sorted parts with their part number, then add
    each part's offset. The written table fixes the boundaries Spark sampled."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = _part([]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_rn", F.row_number().over(inside)).join(offsets, "_part").select(
        *df.columns, (F.col("_rn") + F.col("_off")).cast("long").alias(name))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], descending: bool = False) -> DataFrame:
    """One row per key, the first in order, as an aggregate: partial results
    merge before the shuffle, so hot keys stay cheap. Columns of the order are
    not sent again with the row."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sent = {o: f"_k{i}" for i, o in enumerate(order) if isinstance(o, str) and o in df.columns and o not in keys}
    rest = [c for c in df.columns if c not in keys and c not in sent]
    row = F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order_cols)], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(rest)])
    pick = F.max(row) if descending else F.min(row)
    best = df.groupBy(*keys).agg(pick.alias("_best"))
    place = sent | {c: f"_r{i}" for i, c in enumerate(rest)}
    return best.select(*keys, *[F.col(f"_best.{place[c]}").alias(c) for c in df.columns if c not in keys])


def _cells(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_cell", order_bucket(df, order))


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running maximum in order, cut into day cells carried forward."""
    c = _cells(df, order[0])
    per_cell = c.groupBy(*keys, "_cell").agg(F.max(value).alias("_m"))
    before = _part(keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_cell.select(*keys, "_cell", F.max("_m").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = c.withColumn("_in", F.max(value).over(inside)).join(carry, [*keys, "_cell"])
    return out.select(*df.columns, F.greatest("_in", "_carry").alias(name))


def fill_missing(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, backward: bool = False
) -> DataFrame:
    """Carry the last (or next) observation into missing values."""
    c = _cells(df, order[0])
    stamp = F.struct(*order, value)
    seen = F.when(F.col(value).isNotNull(), stamp)
    per_cell = c.groupBy(*keys, "_cell").agg((F.min(seen) if backward else F.max(seen)).alias("_s"))
    # Backward filling reverses the order: a frame that grows from the start
    # is updated row by row, one that ends at the last row is not.
    turn = (lambda name: F.col(name).desc()) if backward else F.col
    before = _part(keys).orderBy(turn("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(f"_s.{value}", ignorenulls=True).over(before)
    inside = Window.partitionBy(*keys, "_cell").orderBy(*[turn(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(value, ignorenulls=True).over(inside)
    carried = per_cell.select(*keys, "_cell", carry.alias("_carry"))
    out = c.withColumn("_in", local).join(carried, [*keys, "_cell"])
    return out.select(*df.columns, F.coalesce("_in", "_carry").alias(name))


def identify_runs(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run_id") -> DataFrame:
    """Number runs of equal consecutive values from 1 per key."""
    c = _cells(df, order[0])
    last = c.groupBy(*keys, "_cell").agg(F.max(F.struct(*order, value)).alias("_s"))
    by_cell = _part(keys).orderBy("_cell")
    previous = last.select(
        *keys, "_cell", F.lag(f"_s.{value}").over(by_cell).alias("_prev"),
        F.lag(F.lit(True), 1, False).over(by_cell).alias("_has_prev"))
    rows = Window.partitionBy(*keys, "_cell").orderBy(*order)
    flagged = c.withColumn("_lag", F.lag(value).over(rows)).withColumn("_first", F.row_number().over(rows) == 1)
    flagged = flagged.join(previous, [*keys, "_cell"]).withColumn(
        "_opens",
        F.when(
            F.col("_first"),
            F.when(F.col("_has_prev") & F.col(value).eqNullSafe(F.col("_prev")), 0).otherwise(1),
        ).otherwise(F.when(F.col(value).eqNullSafe(F.col("_lag")), 0).otherwise(1)),
    )
    opened = flagged.groupBy(*keys, "_cell").agg(F.sum("_opens").alias("_n"))
    before = by_cell.rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = rows.rowsBetween(Window.unboundedPreceding, 0)
    out = flagged.withColumn("_in", F.sum("_opens").over(inside)).join(offsets, [*keys, "_cell"])
    return out.select(*df.columns, (F.col("_in") + F.col("_off")).cast("long").alias(name))


def hash_order(*parts: Column | str, seed: int = 0) -> Column:
    """A reproducible pseudo-random order key (hex digest). Its prefix is
    uniform, so buckets of it are balanced."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def hash_fraction(*parts: Column | str, seed: int = 0) -> Column:
    """The same digest as a number in [0, 1)."""
    head = F.substring(hash_order(*parts, seed=seed), 1, 12)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**12))
