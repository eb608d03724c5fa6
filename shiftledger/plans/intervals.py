"""Joins of ranges of dates with ranges of dates, by equality on a month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.dates import overlaps


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def _months(first: Column, last: Column) -> Column:
    """Numbers of the months that a closed range touches; none of an empty range."""
    empty = F.array().cast("array<int>")
    return F.when(first <= last, F.sequence(month_number(first), month_number(last))).otherwise(empty)


def _met_by(point: Column, months: Column, point_first: bool) -> Column:
    """The keys of a side: (case, month). In one case its first day is looked up, in the other its range."""

    def keys(case: int, numbers: Column) -> Column:
        return F.transform(numbers, lambda month: F.struct(F.lit(case).alias("case"), month.alias("month")))

    of_point = F.when(point.isNotNull(), F.array(month_number(point))).otherwise(F.array().cast("array<int>"))
    return F.concat(keys(0, of_point if point_first else months), keys(1, months if point_first else of_point))


def candidates(rows: DataFrame, start: Column, end: Column, ranges: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Pairs (_row, _range, _start, _end, _case) that meet in a month, before the exact test.

    If two ranges share a day, either the one of ``ranges`` starts inside the row's (case 0) or the row's starts inside
    the other after its first day (case 1). Either way a day lies in a range: the range is filed under every month it
    touches, the day under its own, and the two meet by equality. So each pair meets once, and those that meet without
    sharing a day lie within a month of each other.
    """
    low, high = F.lit(first), F.lit(last)
    clipped = _months(F.greatest(start, low), F.least(F.coalesce(end, high), high))
    left = rows.select(
        F.struct(*rows.columns).alias("_row"),
        start.alias("_start"),
        end.alias("_end"),
        F.explode(_met_by(start, clipped, point_first=False)).alias("_key"),
    )
    touched = _months(F.col("from_date"), F.col("to_date"))
    right = ranges.select(
        F.struct(*ranges.columns).alias("_range"),
        F.explode(_met_by(F.col("from_date"), touched, point_first=True)).alias("_key"),
    )
    return left.join(right, "_key").select("_row", "_range", "_start", "_end", F.col("_key.case").alias("_case"))


def overlap_join(rows: DataFrame, start: Column, end: Column, ranges: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Each row once for each of ``ranges`` (from_date, to_date, ...) that shares a day with its range of dates.

    No end means still open, no start means never. ``first`` and ``last`` bound ``ranges``. Every row of both sides goes
    through the join once for each month of its own range, never once for each part or partner.
    """
    met = candidates(rows, start, end, ranges, first, last)
    begin, stop = F.col("_range.from_date"), F.col("_range.to_date")
    in_case = F.when(F.col("_case") == 0, F.col("_start") <= begin).otherwise(F.col("_start") > begin)
    exact = in_case & overlaps(F.col("_start"), F.col("_end"), begin, stop)
    return met.filter(exact).select("_row.*", "_range.*")
