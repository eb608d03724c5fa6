"""Date expressions. All are plain Column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_weekday(date: Column) -> Column:
    return F.weekday(date) < 5


def week_start(date: Column) -> Column:
    """Monday of the ISO week that holds ``date``."""
    return F.trunc(date, "week")


def iso_week_monday(year: Column, week: Column) -> Column:
    """Monday of an ISO week; 4 January always lies in week 1."""
    return F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (week - 1) * 7)


def iso_weeks_in_year(year: Column) -> Column:
    """52 or 53; 28 December always lies in the last ISO week."""
    return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))


def iso_week_label(date: Column) -> Column:
    """``2024-07``: ISO year and two-digit ISO week."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), date).cast("string"),
        F.lit("-"),
        F.lpad(F.weekofyear(date).cast("string"), 2, "0"),
    )


def is_date_in_week(date: Column, year: Column, week: Column) -> Column:
    """Calendar year and ISO week number both match. On purpose not the ISO year:
    2024-12-30 counts as week 1 of 2024."""
    return (F.year(date) == year) & (F.weekofyear(date) == week)


def days_between(first: Column, last: Column) -> Column:
    """Array of the days in a closed range; NULL when the range is empty or a bound is NULL,
    so that ``explode`` gives no rows (``sequence`` alone would count downwards)."""
    return F.when(first <= last, F.sequence(first, last))


def month_steps(first: Column, last: Column) -> Column:
    """``first``, then one month later each time, while not after ``last``.

    Each step starts from the previous value, so a day of month that was cut off stays cut off:
    31 January, 28 February, 28 March.
    """
    count = F.greatest(F.floor(F.months_between(last, first)).cast("int") + 1, F.lit(0))
    steps = F.aggregate(
        F.sequence(F.lit(0), count),
        F.array(first),
        lambda dates, _: F.concat(dates, F.array(F.add_months(F.element_at(dates, -1), 1))),
    )
    return F.filter(steps, lambda date: date <= last)


def overlaps(first: Column, last: Column, from_date: Column, to_date: Column) -> Column:
    """An employment or role interval touches a period. No end means still open; no start means never."""
    return (first <= to_date) & (last.isNull() | (last >= from_date))
