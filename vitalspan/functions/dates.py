"""Whole-day date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shift(date: Column | str, days: int | Column) -> Column:
    return F.date_add(col(date), days)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Days from start to end (positive when end is later)."""
    return F.datediff(col(end), col(start))


def days_inclusive(start: Column | str, end: Column | str, inclusive: bool = True) -> Column:
    return days_between(start, end) + (1 if inclusive else 0)


def within(date: Column | str, lo: Column, hi: Column) -> Column:
    return (col(date) >= lo) & (col(date) <= hi)


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (col(a_start) <= col(b_end)) & (col(a_end) >= col(b_start))


def age_by_year(index: Column | str, year_of_birth: Column | str) -> Column:
    return F.year(col(index)) - col(year_of_birth)


def age_by_days(index, year, month, day) -> Column:
    """Completed 365-day years since the birth date."""
    born = F.make_date(col(year).cast("int"), col(month).cast("int"), col(day).cast("int"))
    return (F.datediff(col(index), born) / 365).cast("int")


def resolve_end(start, end, days_supply, zero_supply: str = "plus_one_day") -> Column:
    """Exposure end: recorded end, else start + supply, else start + 1.

    ``zero_supply="same_day"`` lets a supply of 0 end the exposure on its
    start day; the default treats 0 like an unknown supply.
    """
    supply = col(days_supply).cast("int")
    floor = 0 if zero_supply == "same_day" else 1
    by_supply = F.when(supply >= floor, F.date_add(col(start), supply))
    return F.coalesce(col(end), by_supply, F.date_add(col(start), 1))


def days_in_month(date) -> Column:
    return F.dayofmonth(F.last_day(col(date)))


def is_leap_year(date) -> Column:
    y = F.year(col(date))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def decimal_year(date) -> Column:
    y = F.year(col(date))
    length = F.when(is_leap_year(date), 366).otherwise(365)
    return y + (F.dayofyear(col(date)) - 1) / length


def add_months_rolled(date, months: int) -> Column:
    """Month shift that falls back to the last day of a shorter month."""
    return F.add_months(col(date), months)


def round_to_month(date) -> Column:
    """Nearest month start; the midpoint goes up."""
    floor = F.trunc(col(date), "MM")
    ceil = F.add_months(floor, 1)
    return F.when(F.datediff(col(date), floor) < F.datediff(ceil, col(date)), floor).otherwise(ceil)


def ceiling_month(date) -> Column:
    floor = F.trunc(col(date), "MM")
    return F.when(col(date) == floor, floor).otherwise(F.add_months(floor, 1))


def cyclic(position: Column, period: float) -> tuple[Column, Column]:
    angle = position * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
