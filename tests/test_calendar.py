from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftledger import Periods
from shiftledger.functions import dates
from shiftledger.operators import calendar
from shiftledger.plans.periods import iso_week_windows
from tests.conftest import day, rows_of


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_week_dates_start_on_the_monday_of_the_week_with_4_january(spark):
    weeks = spark.createDataFrame([(2021, 1), (2020, 53)], "year int, week int")
    found = rows_of(calendar.week_dates(weeks), "year", "week", "date")
    assert [d for y, w, d in found if w == 1] == [day("2021-01-04") + dt.timedelta(days=i) for i in range(7)]
    assert [d for y, w, d in found if w == 53][0] == day("2020-12-28")


@pytest.mark.parametrize(
    ("date", "year", "week", "expected"),
    [("2024-12-30", 2024, 1, True), ("2024-12-30", 2025, 1, False), ("2024-05-15", 2024, 20, True)],
)
def test_is_date_in_week_uses_the_calendar_year(spark, date, year, week, expected):
    found = value(spark, dates.is_date_in_week(F.lit(day(date)), F.lit(year), F.lit(week)))
    assert found is expected


def test_iso_week_label_uses_the_iso_year(spark):
    assert value(spark, dates.iso_week_label(F.lit(day("2024-12-30")))) == "2025-01"


def test_month_steps_keep_a_cut_off_day(spark):
    steps = value(spark, dates.month_steps(F.lit(day("2024-01-31")), F.lit(day("2024-04-30"))))
    assert steps == [day("2024-01-31"), day("2024-02-29"), day("2024-03-29"), day("2024-04-29")]
    assert value(spark, dates.month_steps(F.lit(day("2024-03-01")), F.lit(day("2024-02-01")))) == []


def test_month_windows_end_before_the_month_and_overlap(spark):
    windows = Periods.month_windows(spark, day("2024-03-15"), day("2024-04-01"), 6)
    assert rows_of(windows.df) == [
        (day("2023-09-01"), day("2024-02-29")),
        (day("2023-10-01"), day("2024-03-31")),
    ]
    assert (windows.first, windows.last) == (day("2023-09-01"), day("2024-03-31"))


def test_year_to_date_windows_run_past_the_end_date(spark):
    windows = Periods.year_to_date(spark, day("2023-11-10"), day("2024-02-10"))
    assert rows_of(windows.df) == [
        (day("2023-11-10"), day("2023-11-30")),
        (day("2023-11-10"), day("2023-12-31")),
        (day("2024-01-01"), day("2024-01-31")),
        (day("2024-01-01"), day("2024-02-29")),
    ]


def test_week_spine_can_miss_a_last_partial_week(spark):
    start, end = day("2024-01-05"), day("2024-01-17")  # Friday to Wednesday
    stepped = [r[0] for r in rows_of(Periods.weeks(spark, start, end).df)]
    whole = [r[0] for r in rows_of(Periods.weeks(spark, start, end, whole=True).df)]
    assert stepped == [day("2024-01-01"), day("2024-01-08")]
    assert whole == [day("2024-01-01"), day("2024-01-08"), day("2024-01-15")]


def test_iso_weeks_count(spark):
    years = spark.createDataFrame([(2020,), (2021,)], "year int")
    weeks = years.select(F.inline(iso_week_windows(F.col("year"))))
    assert {r.iso_year: r["count"] for r in weeks.groupBy("iso_year").count().collect()} == {2020: 53, 2021: 52}


def test_periods_with_a_missing_bound_give_nothing(spark):
    assert Periods.of(spark, [(None, day("2024-01-01"))]).df.count() == 0


def test_business_hours(spark, make_tables):
    t = make_tables(holidays=[{"date": day("2024-05-01"), "name": "x"}, {"date": day("2024-05-04"), "name": "Saturday"}])
    ranges = spark.createDataFrame(
        [
            (1, day("2024-04-29"), day("2024-05-05")),
            (2, day("2024-05-04"), day("2024-05-05")),
            (3, day("2024-05-10"), day("2024-05-01")),
            (4, None, day("2024-05-01")),
        ],
        "id int, s date, e date",
    )
    found = calendar.business_hours(ranges, F.col("s"), F.col("e"), t.holidays)
    assert rows_of(found, "id", "business_hours") == [(1, 30.0), (2, 0.0), (3, 0.0), (4, None)]


def test_business_hours_match_counting_day_by_day(spark):
    holidays = calendar.holidays_dimension(spark, day("2015-12-24"), day("2018-12-31"), (2017, 2018))
    off = {r.date for r in holidays.collect()}
    first = day("2016-01-01")
    ranges = [(i, first + dt.timedelta(days=i * 7 % 900), first + dt.timedelta(days=i * 13 % 900)) for i in range(200)]
    expected = {}
    for i, s, e in ranges:
        days = [s + dt.timedelta(days=n) for n in range((e - s).days + 1)]
        expected[i] = 7.5 * sum(d.weekday() < 5 and d not in off for d in days)
    frame = spark.createDataFrame(ranges, "id int, s date, e date")
    found = calendar.business_hours(frame, F.col("s"), F.col("e"), holidays).select("id", "business_hours").collect()
    assert {r.id: r.business_hours for r in found} == expected


def test_holidays_dimension_reproduces_the_seed_size_and_movable_days(spark):
    seed = calendar.holidays_dimension(spark, day("2015-12-24"), day("2018-12-31"), (2017, 2018))
    named = {r.date: r.name for r in seed.collect()}
    assert len(named) == 54
    assert named[day("2016-03-25")] == "Langfredag"
    assert named[day("2017-06-05")] == "2. pinsedag"
    assert named[day("2018-12-30")] == "Julefri"
    assert day("2016-03-27") not in named


def test_periods_from_a_table_agree_with_literal_periods(spark, make_tables):
    t = make_tables(holidays=[{"date": day("2024-01-01"), "name": "x"}])
    ranges = [(day("2024-01-01"), day("2024-01-31")), (day("2024-01-15"), day("2024-02-15"))]
    literal = Periods.of(spark, ranges)
    table = Periods.from_table(spark.createDataFrame(ranges, "from_date date, to_date date"))
    assert rows_of(calendar.available_dates_in_periods(literal, t.holidays)) == rows_of(
        calendar.available_dates_in_periods(table, t.holidays)
    )


def test_a_span_without_holidays_is_an_empty_dimension(spark):
    none = calendar.holidays_dimension(spark, day("2024-02-01"), day("2024-02-10"))
    assert none.count() == 0 and none.dtypes == [("date", "date"), ("name", "string")]
