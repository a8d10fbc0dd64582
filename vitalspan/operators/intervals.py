"""Gaps-and-islands over date intervals.

All intervals are whole days, so grouping by (keys, start) first leaves at
most one row per calendar day and key: the window that follows stays small
even when one person holds a third of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse_intervals(
    df: DataFrame, keys: list[str], start: str, end: str, gap_days: int = 0,
    sums: dict[str, object] | None = None, count: str | None = None, unique_starts: bool = False,
) -> DataFrame:
    """Merge intervals whose start is at most ``gap_days`` after the latest
    end seen so far. ``sums`` adds per-island totals (name -> column),
    ``count`` names a column with the number of merged rows.

    Rows that end before they start are dropped. ``unique_starts`` promises one
    row per key and start, which saves the first exchange.
    """
    measures = dict(sums or {})
    if count:
        measures[count] = F.lit(1).cast("long")
    valid = df.filter(F.col(end) >= F.col(start))
    if unique_starts:
        daily = valid.select(*keys, start, end, *[c.alias(n) for n, c in measures.items()])
    else:
        daily = valid.groupBy(*keys, start).agg(
            F.max(end).alias(end), *[F.sum(c).alias(n) for n, c in measures.items()])
    if sums or gap_days < 0:
        by_start = Window.partitionBy(*keys).orderBy(start)
        reach = F.date_add(F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), gap_days)
        numbered = daily.withColumn("_opens", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn(
            "_island", F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        return (
            numbered.groupBy(*keys, "_island")
            .agg(F.min(start).alias(start), F.max(end).alias(end), *[F.sum(n).alias(n) for n in measures])
            .drop("_island")
        )
    return _islands(_swept(daily, keys, start, end, list(measures), []), keys, start, end, gap_days, list(measures))


def _swept(daily: DataFrame, keys: list[str], start: str, end: str, totals: list[str], keep: list[str]) -> DataFrame:
    """In one sorted pass, what precedes a row in its key: the latest end as
    ``_reach`` and each total as ``_before_<total>``; and of the whole key
    ``_last`` and ``_all_<total>``. Of the other columns ``keep`` stays."""
    by_start = Window.partitionBy(*keys).orderBy(start)
    earlier = by_start.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return daily.select(
        *keys, start, *keep, F.max(end).over(earlier).alias("_reach"), F.max(end).over(whole).alias("_last"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(n).over(whole).alias(f"_all_{n}") for n in totals])


def _islands(swept: DataFrame, keys: list[str], start: str, end: str, gap_days: int, totals: list[str]) -> DataFrame:
    """One row per island from the rows that open one: it ends where the next
    opening row says that its predecessors do. The order of the sweep is kept,
    so nothing is sorted, hashed or held again. ``gap_days`` is not negative."""
    opening = swept.filter(F.col("_reach").isNull() | (F.col(start) > F.date_add("_reach", gap_days)))
    following = Window.partitionBy(*keys).orderBy(start)

    def upto(before: str, whole: str):
        return F.coalesce(F.lead(before).over(following), F.col(whole))

    return opening.select(
        *keys, start, upto("_reach", "_last").alias(end),
        *[(upto(f"_before_{n}", f"_all_{n}") - F.col(f"_before_{n}")).alias(n) for n in totals])


def collapse_twice(
    df: DataFrame, keys: list[str], start: str, end: str, gap_days: int, count: str, covered: str,
) -> DataFrame:
    """Merge overlapping rows, then merge those islands across ``gap_days``;
    ``count`` is the rows merged and ``covered`` the days spanned by the
    overlap islands inside each result.

    The latest end before a row is the same for rows and for their islands, so
    one sorted pass numbers both levels.
    """
    daily = df.filter(F.col(end) >= F.col(start)).groupBy(*keys, start).agg(
        F.max(end).alias(end), F.count(F.lit(1)).alias(count))
    by_start = Window.partitionBy(*keys).orderBy(start)
    running = by_start.rowsBetween(Window.unboundedPreceding, 0)
    swept = _swept(daily, keys, start, end, [count], [] if gap_days >= 0 else [end, count])
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    if gap_days < 0:
        islands = F.when(F.col(start) <= F.date_add("_reach", gap_days), 0).otherwise(1)
        numbered = swept.withColumn("_sub", F.sum(opens.cast("int")).over(running)).withColumn("_island", F.sum(islands).over(running))
        subs = numbered.groupBy(*keys, "_island", "_sub").agg(
            F.min(start).alias(start), F.max(end).alias(end), F.sum(count).alias(count))
        return subs.groupBy(*keys, "_island").agg(
            F.min(start).alias(start), F.max(end).alias(end), F.sum(count).alias(count),
            F.sum(F.datediff(end, start).cast("long")).alias(covered)).drop("_island")

    def number(date: str):
        return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")

    # an overlap island ends at the reach of the row that opens the next one
    moved = F.when(opens, F.coalesce(number("_reach"), F.lit(0)) - number(start)).otherwise(0)
    whole = by_start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = swept.withColumn("_moved", moved).withColumn(
        f"_before_{covered}", F.sum("_moved").over(running) + number(start)).withColumn(
        f"_all_{covered}", F.sum("_moved").over(whole) + number("_last"))
    return _islands(swept, keys, start, end, gap_days, [count, covered])


def interval_union(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Days covered by either table, as maximal runs of days per key."""
    both = a.select(*keys, start, end).unionByName(b.select(*keys, start, end))
    return collapse_intervals(both, keys, start, end, gap_days=1)


def _coverage(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key, the segments between boundary dates with cover counts a and b."""

    def edges(df: DataFrame, flag: str, other: str) -> DataFrame:
        runs = collapse_intervals(df, keys, start, end, gap_days=1)
        opened = runs.select(*keys, F.col(start).alias("_day"), F.lit(1).alias(flag), F.lit(0).alias(other))
        closed = runs.select(
            *keys, F.date_add(end, 1).alias("_day"), F.lit(-1).alias(flag), F.lit(0).alias(other))
        return opened.unionByName(closed)

    moves = (
        edges(a, "_a", "_b").unionByName(edges(b, "_b", "_a"))
        .groupBy(*keys, "_day").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    w = Window.partitionBy(*keys).orderBy("_day")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return moves.select(
        *keys, F.col("_day").alias(start), F.date_sub(F.lead("_day").over(w), 1).alias(end),
        F.sum("_a").over(running).alias("_in_a"), F.sum("_b").over(running).alias("_in_b"),
    )


def interval_intersection(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    hit = _coverage(a, b, keys, start, end).filter((F.col("_in_a") > 0) & (F.col("_in_b") > 0))
    return collapse_intervals(hit, keys, start, end, gap_days=1)


def interval_difference(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    hit = _coverage(a, b, keys, start, end).filter((F.col("_in_a") > 0) & (F.col("_in_b") == 0))
    return collapse_intervals(hit, keys, start, end, gap_days=1)
