"""Vacation accounts per employee and calendar year."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.codes import HOURS_PER_DAY, VACATION
from shiftledger.sources.tables import Tables

DEFAULT_DAYS = 25


def _years(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last))


def employee_years(t: Tables, as_of: dt.date, version: int = 3) -> DataFrame:
    """One row per employee and calendar year of employment, up to termination or ``as_of``.

    Two superseded rules remain: version 2 counts a year only once its employment day is reached, and
    version 1 also ignores the termination. Both step in years from the employment date, a leap day
    becoming 28 February for good.
    """
    start, today = F.col("date_of_employment"), F.lit(as_of)
    end = today if version == 1 else F.coalesce("termination_date", today)
    years = _years(F.year(start), F.year(end))
    if version < 3:
        day = F.when((F.month(start) == 2) & (F.dayofmonth(start) == 29), 28).otherwise(F.dayofmonth(start))
        years = F.filter(
            years,
            lambda year: F.when(year == F.year(start), start <= end).otherwise(
                F.make_date(year, F.month(start), day) <= end
            ),
        )
    return t.employees.select(F.col("id").alias("employee"), F.explode(years).alias("year"))


def vacation_days_earnt(t: Tables, as_of: dt.date) -> DataFrame:
    """Days earnt per year of employment, 25 unless recorded otherwise."""
    earnt = t.vacation_days.select(F.col("employee_id").alias("employee"), "year", "days_earnt")
    return employee_years(t, as_of).join(earnt, ["employee", "year"], "left").select(
        "employee", "year", F.coalesce("days_earnt", F.lit(float(DEFAULT_DAYS))).alias("days_earnt")
    )


def vacation_days_spent(t: Tables, as_of: dt.date) -> DataFrame:
    """Days of vacation entered per year of employment, 0 if none."""
    spent = (
        t.time_entry.filter(F.col("project") == VACATION)
        .groupBy("employee", F.year("date").alias("year"))
        .agg(F.sum("minutes").alias("minutes"))
    )
    days = F.col("minutes") / F.lit(60.0) / F.lit(HOURS_PER_DAY)
    return employee_years(t, as_of).join(spent, ["employee", "year"], "left").select(
        "employee", "year", F.coalesce(days, F.lit(0.0)).alias("days_spent")
    )


def vacation_days_by_year(t: Tables, as_of: dt.date) -> DataFrame:
    """Both sides of the account."""
    return vacation_days_earnt(t, as_of).join(vacation_days_spent(t, as_of), ["employee", "year"])
