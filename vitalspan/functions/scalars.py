"""Scalar functions under the names used by clinical SQL scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspan.functions.dates import col


def dateadd(part: str, n: int, date) -> Column:
    d = col(date)
    if part == "day":
        return F.date_add(d, n)
    if part == "week":
        return F.date_add(d, 7 * n)
    return F.add_months(d, n * {"month": 1, "quarter": 3, "year": 12}[part])


def datefromparts(y, m, d) -> Column:
    return F.make_date(col(y).cast("int"), col(m).cast("int"), col(d).cast("int"))


def eomonth(date) -> Column:
    return F.last_day(col(date))


def charindex(needle: str, text) -> Column:
    return F.locate(needle, col(text))


def square(x) -> Column:
    return col(x) * col(x)


def isnumeric(text: str) -> Column:
    return F.expr(f"try_cast({text} as double) is not null")


def time_length_months(start, end) -> Column:
    return F.months_between(col(end), col(start), False)


def force_tz(ts, zone: str) -> Column:
    """The instant whose wall clock in ``zone`` shows the timestamp."""
    return F.to_utc_timestamp(col(ts), zone)


def with_tz(ts, zone: str) -> Column:
    """The wall clock in ``zone`` at this instant."""
    return F.from_utc_timestamp(col(ts), zone)
