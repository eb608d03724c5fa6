from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shiftledger import Periods
from shiftledger.operators import capacity, dimensions, entries, kpi
from shiftledger.plans.intervals import candidates
from shiftledger.sources.tables import read_tables, write_snapshot
from tests.conftest import day, in_order, rows_of
from tests.test_plans import plan

BASE = dt.date(2020, 1, 1)


def some_day(rng: random.Random, span: int = 900) -> dt.date:
    return BASE + dt.timedelta(days=rng.randrange(span))


def test_ranges_meet_the_periods_of_a_table_like_all_pairs(spark):
    rng = random.Random(1)
    staff = [(i, rng.choice((None, some_day(rng), some_day(rng))), rng.choice((None, some_day(rng)))) for i in range(120)]
    staff += staff[:5]  # repeated rows stay repeated; some intervals end before they start
    periods = [(some_day(rng), some_day(rng)) for _ in range(60)] + [(BASE, BASE), (BASE, BASE + dt.timedelta(days=2000))]
    rows = spark.createDataFrame(staff, "id int, first date, last date")
    table = Periods.from_table(spark.createDataFrame(periods, "from_date date, to_date date"))
    found = rows_of(table.attach_overlapping(rows, F.col("first"), F.col("last")))
    want = [(*s, *p) for s in staff for p in set(periods) if s[1] and s[1] <= p[1] and (s[2] is None or s[2] >= p[0])]
    assert found == in_order(want)
    listed = Periods.of(spark, periods).attach_overlapping(rows, F.col("first"), F.col("last"))
    assert rows_of(listed) == found


def test_pairs_that_are_compared_grow_with_the_rows(spark):
    """Twice the employees and periods over twice the time: each still meets the few near it."""
    met = []
    for n in (200, 400):
        rng = random.Random(n)
        starts = [some_day(rng, 5 * n) for _ in range(n)]
        staff = [(s, s + dt.timedelta(days=rng.randrange(40))) for s in starts]
        weeks = [(s, s + dt.timedelta(days=6)) for s in (some_day(rng, 5 * n) for _ in range(n))]
        rows = spark.createDataFrame(staff, "first date, last date")
        table = spark.createDataFrame(weeks, "from_date date, to_date date")
        met.append(candidates(rows, F.col("first"), F.col("last"), table, BASE, BASE + dt.timedelta(days=5 * n + 50)).count())
    assert met[1] < 2.5 * met[0] and met[0] < 200 * 200 / 3


def test_every_row_goes_to_each_period_of_a_table(spark):
    rows = spark.range(300).withColumn("name", F.col("id").cast("string"))
    ranges = [(BASE + dt.timedelta(days=i), BASE + dt.timedelta(days=i + 3)) for i in range(20)]
    table = Periods.from_table(spark.createDataFrame(ranges, "from_date date, to_date date"))
    assert rows_of(table.attach(rows)) == in_order((i, str(i), *r) for i in range(300) for r in ranges)


@pytest.mark.parametrize("operator", [entries.accumulated_hours, entries.unregistered_days, entries.time_tracking_status, capacity.availability_percentage, dimensions.employees_in_periods, kpi.hours_per_project])
def test_period_tables_are_neither_gathered_nor_looped_over(spark, make_tables, operator):
    ranges = spark.createDataFrame([(day("2024-01-01"), day("2024-01-31"))], "from_date date, to_date date")
    text = plan(operator(make_tables(), Periods.from_table(ranges)))
    assert not any(word in text for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "collect_list"))


# Days of a project as bits


def entry(employee, project, date, minutes=60):
    return {"employee": employee, "creator": employee, "project": project, "date": date, "minutes": minutes}


def test_projects_in_a_range_like_all_entries(spark, make_tables):
    rng = random.Random(2)
    worked = [(rng.randrange(6), rng.choice("ABCDE"), some_day(rng, 1500)) for _ in range(400)]
    worked += [(1, "A", day("2020-02-29")), (1, "B", day("2023-12-31")), (1, "C", day("2024-01-01")), (1, "D", day("2024-01-31"))]
    t = make_tables(
        customers=[{"id": "c", "name": "Customer"}],
        projects=[{"id": p, "name": p, "customer": "c"} for p in "ABCDE"],
        time_entry=[entry(*w) for w in worked] * 2,
    )
    bounds = [some_day(rng, 1500) for _ in range(40)] + [None, day("2020-02-29"), day("2023-12-31"), day("2024-01-01"), day("2024-01-31")]
    asked = []
    for _ in range(150):
        first, last, left, right = rng.choice(bounds), rng.choice(bounds), rng.choice("[("), rng.choice(")]")
        asked.append((rng.randrange(7), f"{left}{first or ''},{last or ''}{right}"))
    found = rows_of(
        dimensions.projects_info_for_employee_in_range(t, spark.createDataFrame(asked, "employee int, date_range string")),
        "employee", "date_range", "id",
    )
    want = set()
    for employee, text in set(asked):
        first, last = text[1:-1].split(",")
        for who, project, date in worked:
            over = not first or (date.isoformat() >= first if text[0] == "[" else date.isoformat() > first)
            under = not last or (date.isoformat() <= last if text[-1] == "]" else date.isoformat() < last)
            if who == employee and over and under:
                want.add((employee, text, project))
    assert found == in_order(want) and len(want) > 100


def test_a_request_meets_one_row_and_bounds_reach_the_scan(spark, make_tables, tmp_path):
    t = make_tables(time_entry=[entry(e, p, BASE + dt.timedelta(days=i)) for e in range(3) for p in "AB" for i in range(30)])
    looked_up = dimensions.projects_by_day(t.time_entry)
    assert looked_up.count() == 3
    for name in ("time_entry", "projects", "customers"):
        write_snapshot(getattr(t, name), f"{tmp_path}/{name}")
    asked = spark.createDataFrame([(1, "[2020-01-05,2020-01-09]")], "employee int, date_range string")
    stored = read_tables(spark, str(tmp_path))
    text = plan(dimensions.projects_info_for_employee_in_range(stored, asked, day("2020-01-05"), day("2020-01-09")))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "employee" in line)
    assert "GreaterThanOrEqual(date,2020-01-05)" in scan and "LessThanOrEqual(date,2020-01-09)" in scan


# Weeks of employment


def test_weeks_of_the_bonus_are_those_of_the_employment(spark, make_tables):
    staff = [
        {"id": 1, "date_of_employment": day("2019-06-01")},
        {"id": 2, "date_of_employment": day("2020-03-04"), "termination_date": day("2020-03-16")},
        {"id": 3, "date_of_employment": None},
        {"id": 4, "date_of_employment": day("2021-05-01")},
        {"id": 5, "date_of_employment": day("2020-05-01"), "termination_date": day("2020-04-01")},
        {"id": 6, "date_of_employment": day("2010-05-01"), "termination_date": day("2019-12-30")},
    ]
    weeks = Periods.iso_weeks(spark, 2020)
    t = make_tables(employees=staff)
    found = rows_of(entries.employed_weeks(t.employees, weeks), "id", "from_date")
    count = {i: sum(1 for who, _ in found if who == i) for i in range(1, 7)}
    assert count == {1: 53, 2: 3, 3: 0, 4: 0, 5: 0, 6: 1}
    bonus = rows_of(entries.employee_yearly_bonus(t, 2020, 2021), "employee", "year", "bonus")
    assert bonus == [(i, y, 0) for i in range(1, 7) for y in (2020, 2021)]


# Sums over windows


def test_window_sums_equal_those_of_the_rows_per_project(spark, make_tables):
    rng = random.Random(3)
    projects = [{"id": p, "billable": "billable" if p != "N" else "nonbillable", "customer": "c"} for p in "ABCN"]
    invoices = [
        {"id": f"i{i}", "project": rng.choice("ABN"), "date": some_day(rng, 300), "amount": rng.randrange(5), "minutes": rng.randrange(3), "status": rng.choice(("ok", "sent"))}
        for i in range(60)
    ]
    expense = [{"invoice_balance": f"i{rng.randrange(80)}", "type": rng.choice(("other", "subcontractor")), "amount": i} for i in range(90)]
    write_off = [{"invoice_balance": f"i{rng.randrange(80)}", "minutes": i} for i in range(70)]
    time_entry = [entry(1, rng.choice("ABCN"), some_day(rng, 300), rng.choice((None, 30, 45))) for _ in range(200)]
    from decimal import Decimal

    for row in (*invoices, *expense):
        row["amount"] = Decimal(row["amount"])
    t = make_tables(projects=projects, invoice_balance=invoices, expense=expense, write_off=write_off, time_entry=time_entry)
    for fan_out in (True, False):
        windows = Periods.month_windows(spark, day("2020-02-01"), day("2020-12-01"), 1)
        rows = kpi.hours_per_project(t, windows, fan_out).groupBy("start_date", "end_date").agg(
            *[F.sum(c).cast("double") for c in ("invoice_balance_money", "invoice_balance_minutes", "time_entry_minutes", "write_off_minutes", "expense_money", "subcontractor_money")]
        )
        summary = kpi.monthly_balance_summary(t, day("2020-02-01"), day("2020-12-01"), fan_out)
        assert rows_of(summary) == rows_of(rows)
    none = t.replace(projects=t.projects.filter("billable = 'none'"))
    assert kpi.monthly_balance_summary(none, day("2020-02-01"), day("2020-12-01")).count() == 0


# Documents of employees


def test_staffing_documents_nest_weeks_in_projects_in_employees(make_tables):
    t = make_tables(
        employees=[
            {"id": 1, "first_name": "A", "last_name": 'B"', "date_of_employment": day("2020-01-01"), "role": "R"},
            {"id": 2, "first_name": "C", "last_name": "D", "date_of_employment": day("2020-01-01")},
        ],
        projects=[{"id": "P", "name": "p", "billable": "billable"}, {"id": "FER1000", "name": "f", "billable": "unavailable"}],
        staffing=[{"employee": 1, "project": "P", "date": day(d), "percentage": 50} for d in ("2024-01-08", "2024-01-09", "2024-01-15")],
        absence=[{"employee_id": 1, "reason": "FER1000", "date": day("2024-01-10")}],
    )
    found = {r.id: json.loads(r.document) for r in capacity.weekly_staffing_document(t, day("2024-01-08"), day("2024-01-21")).collect()}
    assert found[2] == {"id": 2, "name": "C D", "role": None, "imageUrl": None, "subRows": []}
    assert (found[1]["name"], found[1]["role"]) == ('A B"', "R")
    leave, project = found[1]["subRows"]
    assert leave == {"name": "FER1000", "billable": "unavailable", "project_name": "f", "2024-02": {"dates": {"2024-01-10": 100}, "availability": 80.0}}
    assert project["2024-02"] == {"dates": {"2024-01-08": 50, "2024-01-09": 50}, "availability": 80.0}
    assert project["2024-03"] == {"dates": {"2024-01-15": 50}, "availability": 100.0}
