"""Periods: the (from_date, to_date) rows that a report is asked for."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.functions.dates import days_between, iso_week_monday, iso_weeks_in_year, month_steps, overlaps
from shiftledger.plans.calendar import (
    BROADCAST_ROWS,
    calendar_spanning,
    day_spine,
    small,
    with_workdays,
    workday_calendar,
)
from shiftledger.plans.intervals import overlap_join

KEY = ("from_date", "to_date")
# Column that tables stored by month have, as YYYYMM.
MONTH = "month"
# Parts of the rows that a table of periods is put to as a whole.
PARTS = 64

# Window builders. Each gives an array of (from_date, to_date) structs, so it works on literals and,
# through F.inline, on the columns of a table of requests.


def window(from_date: Column, to_date: Column) -> Column:
    return F.struct(from_date.alias("from_date"), to_date.alias("to_date"))


def months_touched(start: Column, end: Column) -> Column:
    """First days of the months from the one of ``start`` to the one of ``end``."""
    first, last = F.trunc(start, "month"), F.trunc(end, "month")
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))


def month_windows(start: Column, end: Column, months: int) -> Column:
    """For each month touched, the ``months`` months before it: the window ends on the day before that
    month and starts on a month start."""
    return F.transform(
        months_touched(start, end),
        lambda month: window(F.trunc(F.add_months(month, -months), "month"), F.date_sub(month, 1)),
    )


def year_to_date_windows(start: Column, end: Column) -> Column:
    """For each month touched, from the start of its year (or ``start``, if later) to the month's last
    day, even when that day is after ``end``."""
    return F.transform(
        F.when(start <= end, months_touched(start, end)),
        lambda month: window(F.greatest(F.trunc(month, "year"), start), F.last_day(month)),
    )


def iso_week_windows(year: Column) -> Column:
    """All ISO weeks of a year, Monday to Sunday, each with its iso_year and week_number."""

    def week(number: Column) -> Column:
        monday = iso_week_monday(year, number)
        return F.struct(
            monday.alias("from_date"),
            F.date_add(monday, 6).alias("to_date"),
            year.alias("iso_year"),
            number.alias("week_number"),
        )

    return F.transform(F.sequence(F.lit(1), iso_weeks_in_year(year)), week)


def trailing_windows(start: Column, end: Column, weeks: int) -> Column:
    """For each monthly step from ``start``, the ``weeks`` weeks that end on it."""
    return F.transform(month_steps(start, end), lambda day: window(F.date_sub(day, 7 * weeks), day))


class Periods:
    """A table of distinct, non-NULL (from_date, to_date) rows plus what is known about its size.

    ``first`` and ``last`` bound all periods. When the caller knows them they become literal date
    filters that reach the scan of a fact table. ``rows`` is the number of periods and ``longest`` the
    length in days of the longest one; they decide how periods and facts meet. ``windows`` is the same
    rows as one array expression, so that they can be attached to another table without any join.
    """

    def __init__(
        self,
        df: DataFrame,
        first: dt.date | None = None,
        last: dt.date | None = None,
        rows: int | None = None,
        longest: int | None = None,
        windows: Column | None = None,
    ):
        self.df = df
        self.first = first
        self.last = last
        self.rows = rows
        self.longest = longest
        self.windows = windows

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    # Constructors

    @classmethod
    def _of_windows(
        cls, spark: SparkSession, windows: Column, first: dt.date, last: dt.date, rows: int, longest: int
    ) -> Periods:
        return cls(spark.range(1).select(F.inline(windows)), first, last, max(rows, 0), longest, windows)

    @classmethod
    def single(cls, spark: SparkSession, start: dt.date, end: dt.date) -> Periods:
        return cls.of(spark, [(start, end)])

    @classmethod
    def of(cls, spark: SparkSession, ranges: Iterable[tuple[dt.date | None, dt.date | None]]) -> Periods:
        """A list of periods; one with a missing bound gives no result, so it is left out."""
        known = sorted({r for r in ranges if r[0] is not None and r[1] is not None})
        if not known:
            none = F.lit(None).cast("date")
            return cls(spark.range(0).select(none.alias("from_date"), none.alias("to_date")))
        windows = F.array(*[window(F.lit(a), F.lit(b)) for a, b in known])
        longest = max((b - a).days + 1 for a, b in known)
        return cls._of_windows(spark, windows, known[0][0], max(b for _, b in known), len(known), longest)

    @classmethod
    def from_table(cls, df: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> Periods:
        """Periods found in data; give ``first`` and ``last`` when they are known bounds."""
        return cls(df.select(*KEY).dropna().distinct(), first, last)

    @classmethod
    def month_windows(cls, spark: SparkSession, start: dt.date, end: dt.date, months: int = 6) -> Periods:
        back = start.year * 12 + start.month - 1 - months
        return cls._of_windows(
            spark,
            month_windows(F.lit(start), F.lit(end), months),
            dt.date(back // 12, back % 12 + 1, 1),
            end.replace(day=1) - dt.timedelta(days=1),
            _months_touched(start, end),
            31 * months,
        )

    @classmethod
    def year_to_date(cls, spark: SparkSession, start: dt.date, end: dt.date) -> Periods:
        month_end = (end.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
        windows = year_to_date_windows(F.lit(start), F.lit(end))
        return cls._of_windows(spark, windows, start, month_end, _months_touched(start, end), 366)

    @classmethod
    def weeks(cls, spark: SparkSession, start: dt.date, end: dt.date, days: int = 7, whole: bool = False) -> Periods:
        """The ISO weeks reached by stepping seven days from ``start`` while not after ``end``: a last
        partial week is missed when the steps jump over its beginning. ``whole`` steps from Monday to
        Monday instead and misses none. ``days`` is the length of each window."""
        monday = start - dt.timedelta(days=start.weekday())
        count = max((end - (monday if whole else start)).days // 7 + 1, 0)
        mondays = F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")
        windows = F.transform(
            mondays,
            lambda week: window(F.date_add(F.lit(monday), week * 7), F.date_add(F.lit(monday), week * 7 + (days - 1))),
        )
        last = monday + dt.timedelta(days=7 * max(count - 1, 0) + days - 1)
        return cls._of_windows(spark, windows, monday, last, count, days)

    @classmethod
    def iso_weeks(cls, spark: SparkSession, first_year: int, last_year: int | None = None) -> Periods:
        """All ISO weeks of one or several years; the table also has iso_year and week_number."""
        last_year = first_year if last_year is None else last_year
        first, after = dt.date.fromisocalendar(first_year, 1, 1), dt.date.fromisocalendar(last_year + 1, 1, 1)
        windows = F.flatten(F.transform(F.sequence(F.lit(first_year), F.lit(last_year)), iso_week_windows))
        return cls._of_windows(spark, windows, first, after - dt.timedelta(days=1), (after - first).days // 7, 7)

    @classmethod
    def trailing_weeks(cls, spark: SparkSession, start: dt.date, end: dt.date, weeks: int = 12) -> Periods:
        """For each monthly step from ``start``, the ``weeks`` weeks that end on it."""
        windows = trailing_windows(F.lit(start), F.lit(end), weeks)
        first = start - dt.timedelta(weeks=weeks)
        return cls._of_windows(spark, windows, first, end, _months_touched(start, end), 7 * weeks + 1)

    # Use

    def bounded(self) -> Periods:
        """The same periods with known bounds; those of a table are its least start and greatest end."""
        if self.first is not None and self.last is not None:
            return self
        first, last = self.df.agg(F.min("from_date"), F.max("to_date")).first()
        epoch = dt.date(1970, 1, 1)  # of no periods
        return Periods(self.df, self.first or first or epoch, self.last or last or epoch, self.rows, self.longest, self.windows)

    def restrict(self, fact: DataFrame, column: str = "date") -> DataFrame:
        """Keep only the rows of a fact that some period can need."""
        if self.first is None or self.last is None:
            return fact
        kept = fact.filter(F.col(column).between(F.lit(self.first), F.lit(self.last)))
        if MONTH in fact.columns and column == "date":  # of a table stored by month, other months are not even listed
            first, last = (day.year * 100 + day.month for day in (self.first, self.last))
            kept = kept.filter(F.col(MONTH).between(first, last))
        return kept

    def attach(self, rows: DataFrame) -> DataFrame:
        """Each row once per period. The periods are what is asked, so every pair is a row of the answer.

        Of a table of periods each part of the rows gets a copy; a row itself is dealt to one part.
        """
        if self.windows is None:
            part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).alias("_part")
            parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part")
            return rows.select("*", part).join(self.df.select("*", parts), "_part").drop("_part")
        return rows.select("*", F.inline(self.windows))

    def attach_overlapping(self, rows: DataFrame, start: Column, end: Column) -> DataFrame:
        """Each row once per period that its range from ``start`` to ``end`` touches (see ``overlaps``).

        Windows known as an expression are tested row by row. A table of periods is joined by equality on months, for
        which its bounds are needed: where they are not given, a job finds them while the plan is built.
        """
        if self.windows is None:
            known = self.bounded()
            return overlap_join(rows, start, end, self.df, known.first, known.last)
        met = F.filter(self.windows, lambda w: overlaps(start, end, w["from_date"], w["to_date"]))
        return rows.select("*", F.inline(met))

    def days(self, holidays: DataFrame | None = None) -> DataFrame:
        """Every day of every period, ready to be joined to day-level rows on ``date``; with ``holidays``,
        also whether it is a working day.

        Spark estimates this table by the few rows before the explode, so the size is checked here:
        broadcast when the bound is small, sort-merge join when it is large or unknown.
        """
        days = self.df.select(*KEY, F.explode(days_between(F.col("from_date"), F.col("to_date"))).alias("date"))
        if holidays is not None:
            days = days.join(small(self.calendar(holidays).select("date", "workdays"), self.span_days), "date")
        return days.hint("merge") if self.many_days else F.broadcast(days)

    @property
    def many_days(self) -> bool:
        """Are the days of all periods too many to be broadcast? Unknown counts as yes."""
        if self.rows is None or self.span_days is None:
            return True
        longest = self.span_days if self.longest is None else min(self.longest, self.span_days)
        return self.rows * longest > BROADCAST_ROWS

    @property
    def overlapping(self) -> bool:
        """Can a day lie in many periods? Unknown counts as yes."""
        if self.rows is None or self.longest is None or self.span_days is None:
            return True
        return self.rows * self.longest > 2 * self.span_days

    def sum_by(self, rows: DataFrame, *keys: str, **measures: Column) -> DataFrame:
        """Sum row-level measures by key and period.

        Periods that hardly overlap are attached to the rows directly and combined inside each task: one
        shuffle of (key, period) sums. Where each day lies in many periods, or the days must be joined by a
        shuffle, rows are first folded to (key, date), so that only day sums are multiplied or moved.
        """
        rows = rows.select(*keys, "date", *[column.alias(name) for name, column in measures.items()])
        sums = [F.sum(name).alias(name) for name in measures]
        if self.overlapping or self.many_days:
            rows = rows.groupBy(*keys, "date").agg(*sums)
        return rows.join(self.days(), "date").groupBy(*KEY, *keys).agg(*sums)

    @property
    def span_days(self) -> int | None:
        """Length of the calendar over all periods, if known. It includes the day after the last one."""
        if self.first is None or self.last is None:
            return None
        return max((self.last - self.first).days, 0) + 2

    def calendar(self, holidays: DataFrame) -> DataFrame:
        """Workday calendar over all periods."""
        if self.span_days is None:
            return calendar_spanning(self.df, "from_date", "to_date", holidays)
        last = self.first + dt.timedelta(days=self.span_days - 1)
        return workday_calendar(day_spine(self.spark, self.first, last), holidays)

    def with_workdays(self, rows: DataFrame, holidays: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
        """Add the working days of a range inside the periods, e.g. of a period cut to an employment."""
        return with_workdays(rows, start, end, self.calendar(holidays), name, self.span_days)

    def total(self, daily: DataFrame, *measures: str) -> DataFrame:
        """Sum day-level measures over each period. A period without any such day keeps NULL sums."""
        sums = self.days().join(daily, "date").groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in measures])
        return self.df.join(sums, list(KEY), "left")


def _months_touched(start: dt.date, end: dt.date) -> int:
    return (end.year - start.year) * 12 + end.month - start.month + 1
