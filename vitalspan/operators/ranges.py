"""Joins on a person key plus a date range.

A plain join on the person key compares every pair of one person's rows. Here
both sides also carry a calendar bucket as wide as the longest window, so a
row meets at most two buckets of partners, and one very active person spreads
over many join keys instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.dates import col
from vitalspan.session import materialize

_BUCKET = "_bucket"


def _bucket_of(date, width: int):
    return F.floor(F.unix_date(col(date)) / width)


def band_join(
    left: DataFrame, right: DataFrame, on: list[str], lo: str, hi: str, date: str, span_days: int,
) -> DataFrame:
    """Inner join: equal ``on`` columns and ``lo <= date <= hi``.

    ``lo``/``hi`` are date columns of ``left`` at most ``span_days`` apart,
    ``date`` a column of ``right``. Other column names must not clash.
    """
    width = span_days + 1
    l = left.filter(F.col(lo) <= F.col(hi)).withColumn(
        _BUCKET, F.explode(F.sequence(_bucket_of(lo, width), _bucket_of(hi, width))))
    r = right.withColumn(_BUCKET, _bucket_of(date, width))
    joined = l.join(r, [*on, _BUCKET])
    return joined.filter((F.col(date) >= F.col(lo)) & (F.col(date) <= F.col(hi))).drop(_BUCKET)


# An interval over more buckets than this meets its partners by key alone.
_LONG = 8
_RIGHT_LONG, _LEFT_LONG = -(10**9), -2 * 10**9


def overlap_join(
    left: DataFrame, right: DataFrame, on: list[str], lo: str, hi: str, start: str, end: str, width: int = 366,
) -> DataFrame:
    """Inner join where ``[start, end]`` of right overlaps ``[lo, hi]`` of left.

    Intervals of a few buckets meet in the first bucket both share. A longer
    one (an open end, say) is not spread: it meets all partners of its key,
    most of which it overlaps. Every row has at most ten join keys, whatever
    the dates, and each pair is produced once.
    """
    def spread(df, a, b, long_keys: list[int], short_key: int):
        first, last = _bucket_of(a, width), _bucket_of(b, width)
        fine = F.concat(F.sequence(first, F.least(last, first + _LONG - 1)), F.array(F.lit(short_key).cast("long")))
        keys = F.when(last - first >= _LONG, F.array(*[F.lit(k).cast("long") for k in long_keys])).otherwise(fine)
        return df.filter(F.col(a) <= F.col(b)).withColumn(_BUCKET, F.explode(keys))

    joined = spread(left, lo, hi, [_RIGHT_LONG, _LEFT_LONG], _RIGHT_LONG).join(
        spread(right, start, end, [_RIGHT_LONG], _LEFT_LONG), [*on, _BUCKET])
    first_shared = F.greatest(_bucket_of(lo, width), _bucket_of(start, width))
    return joined.filter(
        (F.col(start) <= F.col(hi)) & (F.col(end) >= F.col(lo))
        & ((F.col(_BUCKET) <= _RIGHT_LONG) | (F.col(_BUCKET) == first_shared))
    ).drop(_BUCKET)


def window_counts(
    events: DataFrame, records: DataFrame, on: list[str], index: str, record_date: str,
    lo_days: int, hi_days: int, criteria: dict[str, object],
    bounds: tuple[str, str] | None = None,
) -> DataFrame:
    """For each event the number of records per criterion in
    ``[index + lo_days, index + hi_days]``, clipped to ``bounds`` if given.

    Records shrink to one row per person and day, which is written, then dealt
    by person and listed by person and calendar bucket of the window's length.
    An event meets the lists of its person and looks into the two its window
    touches: events are shuffled once, as they are, and stay dealt by ``on``.
    Event rows without any match get zeros.
    """
    names = list(criteria)
    daily = records.groupBy(*on, F.col(record_date).alias("_day")).agg(
        *[F.sum(F.when(criteria[n], 1).otherwise(0)).alias(n) for n in names])
    daily = materialize(daily.filter(" OR ".join(f"`{n}` > 0" for n in names)).filter("_day IS NOT NULL"), "daily")
    width = hi_days - lo_days + 1
    lists = daily.repartition(*on).groupBy(*on, _bucket_of("_day", width).alias(_BUCKET)).agg(
        F.collect_list(F.struct("_day", *names)).alias("_days"))
    lists = lists.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct(_BUCKET, "_days"))).alias("_lists"))
    lo, hi = F.date_add(F.col(index), lo_days), F.date_add(F.col(index), hi_days)
    known = F.col(index).isNotNull()
    if bounds:
        lo, hi = F.greatest(lo, F.col(bounds[0])), F.least(hi, F.col(bounds[1]))
        known = known & F.col(bounds[0]).isNotNull() & F.col(bounds[1]).isNotNull()
    first = _bucket_of(lo, width)
    none = F.array().cast(lists.schema["_lists"].dataType.valueType)
    near = F.concat(*[F.coalesce(F.try_element_at("_lists", b), none) for b in (first, first + 1)])
    met = events.join(lists, on, "left").withColumn(
        "_met", F.when(known, F.filter(near, lambda d: (d["_day"] >= lo) & (d["_day"] <= hi))))
    zero = F.lit(0).cast("long")

    def total(name: str):
        return F.coalesce(F.aggregate("_met", zero, lambda n, d: n + d[name]), zero).alias(name)

    return met.select(*events.columns, *[total(n) for n in names])


def interval_counts(windows: DataFrame, points: DataFrame, on: list[str], lo: str, hi: str, date: str) -> DataFrame:
    """For each distinct (on, lo, hi) the number of points in ``[lo, hi]`` as
    ``n`` and the first of them as ``first``, for windows of any length.

    Points and window edges of one key are swept once in date order: the
    count is a difference of two running counts, so no (window, point) pair is
    ever formed. Both sides hold at most one row per day (or day pair) and key.
    """
    days = points.groupBy(*on, F.col(date).alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    spans = windows.select(*on, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).filter(F.col("_lo") <= F.col("_hi")).distinct()
    edges = spans.select(*on, "_lo", "_hi", F.explode(F.array(F.date_sub("_lo", 1), F.col("_hi"))).alias("_day"))
    none = F.lit(None).cast("date")
    marks = days.select(*on, "_day", "_c", none.alias("_lo"), none.alias("_hi"), F.lit(0).alias("_edge")).unionByName(
        edges.select(*on, "_day", F.lit(0).cast("long").alias("_c"), "_lo", "_hi", F.lit(1).alias("_edge")))
    forward = Window.partitionBy(*on).orderBy("_day", "_edge").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*on).orderBy(F.col("_day").desc(), F.col("_edge").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("_cum", F.sum("_c").over(forward)).withColumn(
        "_next", F.last(F.when(F.col("_edge") == 0, F.col("_day")), ignorenulls=True).over(back))
    at_hi = F.col("_day") == F.col("_hi")
    out = seen.filter(F.col("_edge") == 1).groupBy(*on, "_lo", "_hi").agg(
        (F.max(F.when(at_hi, F.col("_cum"))) - F.max(F.when(~at_hi, F.col("_cum")))).alias("n"),
        F.max(F.when(~at_hi, F.col("_next"))).alias("first"))
    return out.select(
        *on, F.col("_lo").alias(lo), F.col("_hi").alias(hi), "n",
        F.when(F.col("n") > 0, F.col("first")).alias("first"))


def without_record(events: DataFrame, records: DataFrame, on: list[str], index: str, record_date: str, lo_days: int, hi_days: int) -> DataFrame:
    """Events with no record at all in ``[index + lo_days, index + hi_days]``.

    Nothing is counted: records shrink to one row per key and day, event days
    that meet one are listed once, and an anti join leaves the others.
    """
    days = records.select(*on, F.col(record_date).alias("_day")).distinct()
    asked = events.select(*on, F.col(index).alias("_index")).distinct().withColumn("_lo", F.date_add("_index", lo_days)).withColumn(
        "_hi", F.date_add("_index", hi_days))
    met = band_join(asked, days, on, "_lo", "_hi", "_day", hi_days - lo_days).select(*on, F.col("_index").alias(index)).distinct()
    return events.join(met, [*on, index], "left_anti")


def first_dates(records: DataFrame, on: list[str], date: str, alias: str = "_first") -> DataFrame:
    return records.groupBy(*on).agg(F.min(date).alias(alias))


def without_earlier(left: DataFrame, records: DataFrame, on: list[str], date: str, before) -> DataFrame:
    """Rows of left with no record dated strictly before ``before``.

    Only each key's earliest record matters, so the right side shrinks to one
    row per key and the join keeps at most one match per row.
    """
    earliest = first_dates(records, on, date)
    joined = left.join(earliest, on, "left")
    return joined.filter(F.col("_first").isNull() | (F.col("_first") >= before)).drop("_first")


def with_earlier(left: DataFrame, records: DataFrame, on: list[str], date: str, before) -> DataFrame:
    earliest = first_dates(records, on, date)
    return left.join(earliest, on).filter(F.col("_first") < before).drop("_first")


def period_of(events: DataFrame, observation_period: DataFrame, date: str, person: str = "person_id") -> DataFrame:
    """Attach the observation period that contains the event date."""
    op = observation_period.select(
        F.col("person_id").alias("_op_person"), F.col("observation_period_start_date").alias("op_start_date"),
        F.col("observation_period_end_date").alias("op_end_date"))
    return events.join(
        op, (F.col(person) == F.col("_op_person")) & (F.col(date) >= F.col("op_start_date"))
        & (F.col(date) <= F.col("op_end_date"))
    ).drop("_op_person")
