"""Calendar operators over tables of dates, weeks and ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.functions.codes import HOURS_PER_DAY
from shiftledger.functions.dates import iso_week_monday
from shiftledger.plans.calendar import calendar_spanning, with_workdays
from shiftledger.plans.periods import Periods

# Names of the public and company holidays, by day and month or by distance from Easter Sunday.
FIXED_HOLIDAYS = {
    (1, 1): "1. nyttårsdag",
    (5, 1): "Arbeidernes internasjonale kampdag",
    (5, 17): "Grunnlovsdag",
    (12, 24): "Julaften",
    (12, 25): "1. juledag",
    (12, 26): "2. juledag",
    (12, 31): "Nyttårsaften",
}
EASTER_HOLIDAYS = {
    -7: "Palmesøndag",
    -3: "Skjærtorsdag",
    -2: "Langfredag",
    1: "2. påskedag",
    39: "Kristi himmelfartsdag",
    49: "1. pinsedag",
    50: "2. pinsedag",
}
CHRISTMAS_BREAK = "Julefri"


def easter_sunday(year: int) -> dt.date:
    """Gregorian Easter by the anonymous (Meeus/Jones/Butcher) rule."""
    century, rest = divmod(year, 100)
    golden = year % 19
    shift = (century - (century + 8) // 25 + 1) // 3
    moon = (19 * golden + century - century // 4 - shift + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * (rest // 4) - moon - rest % 4) % 7
    late = (golden + 11 * moon + 22 * weekday) // 451
    month, day = divmod(moon + weekday - 7 * late + 114, 31)
    return dt.date(year, month, day + 1)


def holidays_dimension(
    spark: SparkSession, first: dt.date, last: dt.date, break_years: tuple[int, ...] = ()
) -> DataFrame:
    """Holiday dimension for a span of days; ``break_years`` also close between Christmas and New Year.

    The seed of the data contract is 2015-12-24 .. 2018-12-31 with break years 2017 and 2018.
    """
    named: dict[dt.date, str] = {}
    for year in range(first.year, last.year + 1):
        easter = easter_sunday(year)
        days = {dt.date(year, m, d): name for (m, d), name in FIXED_HOLIDAYS.items()}
        days |= {easter + dt.timedelta(days=n): name for n, name in EASTER_HOLIDAYS.items() if n}
        if year in break_years:
            days |= {dt.date(year, 12, d): CHRISTMAS_BREAK for d in range(27, 31)}
        named |= days
    rows = [F.struct(F.lit(day).alias("date"), F.lit(name).alias("name")) for day, name in sorted(named.items()) if first <= day <= last]
    kind = "array<struct<date:date,name:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def only_holidays(rows: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date is a holiday."""
    return rows.join(holidays.select(F.col("date").alias(date)), date, "left_semi")


def without_holidays(rows: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose date is not a holiday."""
    return rows.join(holidays.select(F.col("date").alias(date)), date, "left_anti")


def week_dates(weeks: DataFrame) -> DataFrame:
    """Seven dates for each (year, week) row."""
    monday = iso_week_monday(F.col("year"), F.col("week"))
    return weeks.withColumn("date", F.explode(F.sequence(monday, F.date_add(monday, 6))))


def available_dates_in_periods(periods: Periods, holidays: DataFrame) -> DataFrame:
    """Working days of each period: weekdays that are not holidays."""
    workdays = periods.calendar(holidays).filter("workdays = 1").select("date")
    return periods.days().join(workdays, "date").select("from_date", "to_date", F.col("date").alias("available_date"))


def business_hours(
    ranges: DataFrame, start: Column, end: Column, holidays: DataFrame, calendar: DataFrame | None = None
) -> DataFrame:
    """Add business_hours: 7.5 hours for each working day of a closed range.

    NULL for a NULL bound, 0 for an empty range. Without a calendar, one covering all ranges is
    derived from the table itself.
    """
    if calendar is None:
        bounds = ranges.select(start.alias("_lo"), end.alias("_hi"))
        calendar = calendar_spanning(bounds, "_lo", "_hi", holidays)
    counted = with_workdays(ranges, start, end, calendar, "_workdays")
    return counted.withColumn("business_hours", F.col("_workdays") * F.lit(HOURS_PER_DAY)).drop("_workdays")
