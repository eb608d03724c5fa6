"""Day-level calendars: small, bounded by the span in days, and joined by equality on the date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftledger.functions.dates import days_between, is_weekday

# A calendar or period table of at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def day_spine(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per day of a closed range."""
    return spark.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("date")
    )


def workday_calendar(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Per day: is it a working day, and how many working days lie before it.

    The running count is over the calendar only, never over a fact, so one task is enough: a
    century is 36,525 rows.
    """
    off = holidays.select("date").distinct().withColumn("off", F.lit(True))
    flagged = days.join(off, "date", "left").select(
        "date", (is_weekday(F.col("date")) & F.col("off").isNull()).cast("int").alias("workdays")
    )
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return flagged.withColumn("workdays_before", F.coalesce(F.sum("workdays").over(before), F.lit(0)))


def calendar_spanning(ranges: DataFrame, start: str, end: str, holidays: DataFrame) -> DataFrame:
    """Workday calendar covering every range in a table and the day after; the span is found inside the
    same job."""
    span = ranges.agg(F.min(start).alias("first"), F.date_add(F.max(end), 1).alias("last"))
    days = span.select(F.explode(days_between(F.col("first"), F.col("last"))).alias("date"))
    return workday_calendar(days, holidays)


def small(frame: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a frame whose size is known and small; otherwise leave the choice to Spark."""
    return F.broadcast(frame) if rows is not None and rows <= BROADCAST_ROWS else frame


def with_workdays(
    ranges: DataFrame, start: Column, end: Column, calendar: DataFrame, name: str, days: int | None = None
) -> DataFrame:
    """Add the number of working days in a closed range: the count before the day after it, less the count
    before it. Both look-ups read the same two columns, so Spark builds one broadcast for them.

    NULL bound gives NULL and an empty range gives 0. Non-empty ranges, and the day after, must lie
    inside the calendar; ``days`` is its length, if known.
    """

    def lookup(date: str, count: str) -> DataFrame:
        return small(calendar.select(F.col("date").alias(date), F.col("workdays_before").alias(count)), days)

    count = (
        F.when(start.isNull() | end.isNull(), F.lit(None))
        .when(start <= end, F.col("_upto") - F.col("_before"))
        .otherwise(0)
        .cast("long")
    )
    return (
        ranges.join(lookup("_start", "_before"), start == F.col("_start"), "left")
        .join(lookup("_after", "_upto"), F.date_add(end, 1) == F.col("_after"), "left")
        .withColumn(name, count)
        .drop("_start", "_after", "_before", "_upto")
    )
