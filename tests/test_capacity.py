from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest

from shiftledger import Periods
from shiftledger.operators import capacity, kpi, vacation
from tests.conftest import day, rows_of

WEEK = (day("2024-01-08"), day("2024-01-14"))


def staffed(employee, project, date, percentage=100):
    return {"employee": employee, "project": project, "date": day(date), "percentage": percentage}


def absent(employee, reason, date, percentage=100):
    return {"employee_id": employee, "reason": reason, "date": day(date), "percentage": percentage}


@pytest.fixture(scope="module")
def t(make_tables):
    return make_tables(
        employees=[
            {"id": 1, "first_name": "A", "last_name": "B", "date_of_employment": day("2020-01-01"), "has_permanent_position": True},
            {
                "id": 2,
                "first_name": "C",
                "last_name": "D",
                "date_of_employment": day("2024-01-09"),
                "termination_date": day("2024-01-10"),
                "has_permanent_position": False,
            },
            {"id": 3, "first_name": "E", "last_name": "F"},
        ],
        customers=[{"id": "c", "name": "Customer"}],
        projects=[
            {"id": "B"},
            {"id": "N", "billable": "nonbillable"},
            {"id": "FER1000", "billable": "unavailable"},
            {"id": "U", "billable": "unavailable"},
            {"id": "FAG1000", "billable": "nonbillable", "deductable": True},
        ],
        staffing=[
            staffed(1, "B", "2024-01-08", 60),
            staffed(1, "N", "2024-01-08", 30),
            staffed(1, "U", "2024-01-09"),
            staffed(1, "U", "2024-01-10"),
            staffed(1, "B", "2024-01-10"),
            staffed(2, "U", "2024-01-12"),  # after termination
            staffed(1, "B", "2024-01-12"),  # holiday
        ],
        absence=[absent(1, "FER1000", "2024-01-08", 50), absent(1, "FER1000", "2024-01-11"), absent(2, "AVS", "2024-01-10")],
        holidays=[{"date": day("2024-01-12"), "name": "x"}],
        time_entry=[
            {"employee": 1, "project": "B", "date": day("2024-01-08"), "minutes": 450},
            {"employee": 1, "project": "FER1000", "date": day("2024-01-11"), "minutes": 90},
            {"employee": 2, "project": "FAG1000", "date": day("2024-01-09"), "minutes": 120},
        ],
    )


def test_staffed_hours_are_cut_at_full_time(t):
    assert rows_of(capacity.staffed_hours(t)) == [
        (1, day("2024-01-08"), (90 - 40) * 0.375),
        (1, day("2024-01-09"), 37.5),
        (1, day("2024-01-10"), 75.0),
        (1, day("2024-01-11"), 0.0),
        (2, day("2024-01-10"), 0.0),
    ]


def test_available_dates(spark, t):
    asked = spark.createDataFrame([(1, 2024, 2), (2, 2024, 2)], "employee int, year int, week int")
    found = rows_of(capacity.available_dates(t, asked), "employee", "available_date")
    assert found == [(2, day("2024-01-08")), (2, day("2024-01-09")), (2, day("2024-01-11"))]


def test_weekly_buckets(spark, t):
    found = rows_of(capacity.worked_days_per_week(t, day("2024-01-03"), 2))
    assert found == [
        (1, ["B", "B", "U"], day("2024-01-10"), 3),
        (1, ["B", "N", "U"], day("2024-01-03"), 3),
        (2, ["U"], day("2024-01-10"), 1),
    ]
    with pytest.raises(ValueError, match="greater than 0"):
        capacity.worked_days_per_week(t, day("2024-01-03"), 0)
    assert capacity.default_start_of_week(day("2024-01-14")) == day("2024-01-15")
    assert capacity.default_start_of_week(day("2024-01-13")) == day("2024-01-08")


def test_weekly_staffing_document(spark, t):
    found = {(r.id, r.project): r.sub_row for r in capacity.weekly_staffing_json(t, *WEEK).collect()}
    assert set(found) == {(1, "B"), (1, "N"), (1, "U"), (1, "FER1000"), (2, "U"), (2, "AVS")}
    assert json.loads(found[1, "FER1000"]) == {
        "name": "FER1000",
        "billable": "unavailable",
        "project_name": "",
        "2024-02": {"dates": {"2024-01-08": 100, "2024-01-11": 100}, "availability": 50.0},
    }
    quiet = capacity.weekly_staffing_json(t, day("2022-01-03"), day("2022-01-09")).collect()
    assert [(r.id, r.sub_row) for r in quiet] == [(1, None)]


def test_availability(spark, t):
    periods = Periods.of(spark, [WEEK, (day("2024-01-13"), day("2024-01-14"))])
    company = rows_of(capacity.availability_percentage(t, periods), "from_date", "availability")
    assert company == [(WEEK[0], Decimal("75.00")), (day("2024-01-13"), Decimal("0.00"))]
    alone = rows_of(capacity.employee_availability_percentage(t, Periods.single(spark, *WEEK)), "employee", "availability")
    assert alone == [(1, Decimal("50.00")), (2, Decimal("100.00")), (3, Decimal("100.00"))]


def test_weekly_availability_looks_into_the_next_monday(spark, t, make_tables):
    monday_off = t.replace(absence=make_tables(absence=[absent(1, "FER1000", "2024-01-15")]).absence)
    found = json.loads(capacity.weekly_availability_json(monday_off, *WEEK).first().result)
    assert found == {"2024-02": 90.0}  # five working days for each of two people


def test_weekly_fg_object(spark, t):
    found = json.loads(capacity.weekly_fg_json(t, day("2024-01-08"), day("2024-01-15")).first().result)
    billable, available = 260 * 0.075, (2 * 4 - 2) * 7.5
    assert found == {"2024-02": round(billable / available * 100, 1), "2024-03": 0.0}


def test_forecast(spark, t):
    row = capacity.forecasted_available_hours(t, Periods.single(spark, *WEEK)).first()
    # Employee 3 without a start date counts as employed, 2 only on two days; staffing after termination does not count.
    assert (row.all_hours, row.unavail_staffing_hours, row.unavail_absence_hours) == ((4 + 2 + 4) * 7.5, 15.0, 15.0)
    assert capacity.forecasted_fg(t, Periods.single(spark, *WEEK)).first().planned_billable_hours == 22.5
    weekly = json.loads(capacity.weekly_forecasted_fg_json(t, *WEEK).first().result)
    assert weekly == {"2024-02": int(22.5 / 45.0 * 100)}


def test_possible_work_days(spark, t):
    found = rows_of(capacity.possible_work_dates_per_employee(t, Periods.single(spark, *WEEK)), "employee_id", "work_day")
    # 8th absent, 9th only unavailable staffing, 10th also billable staffing, 11th absent, 12th holiday.
    assert found == [(1, day("2024-01-10")), (2, day("2024-01-09")), (2, day("2024-01-10"))]
    hours = capacity.accumulated_staffing_hours(t, Periods.single(spark, *WEEK)).first()
    assert (hours.available_hours, hours.billable_hours, hours.unavailable_hours) == (22.5, 22.5, 22.5)
    pairs = spark.createDataFrame([(1, day("2024-01-10")), (1, day("2024-01-09")), (9, day("2024-01-10"))], "employee int, date date")
    assert [r[2] for r in rows_of(capacity.is_possible_work_day(t, pairs))] == [False, True, False]


def test_head_count_equals_expanded_employees(spark, t):
    periods = Periods.of(spark, [WEEK, (day("2023-12-25"), day("2024-02-02")), (day("2019-01-01"), day("2019-12-31"))])
    expanded = capacity.all_employee_work_dates(t, periods).groupBy("from_date").count().collect()
    totals = capacity.sum_business_hours(t, periods).collect()
    assert {r.from_date: r.sum_business_hours for r in totals} == {r.from_date: r["count"] * 7.5 for r in expanded}


def test_billed_hours_need_billable_entries(spark, t):
    periods = Periods.of(spark, [WEEK, (day("2024-01-08"), day("2024-01-08")), (day("2024-01-09"), day("2024-01-09"))])
    found = rows_of(capacity.accumulated_billed_hours(t, periods))
    assert found == [
        (day("2024-01-08"), day("2024-01-08"), None, 7.5),
        (day("2024-01-08"), day("2024-01-14"), 75.0 - 1.5, 7.5),
    ]


def test_overview_names_weeks_by_calendar_year(spark, t):
    found = rows_of(capacity.staffing_and_billing_overview(t, day("2024-01-09"), day("2024-01-09")), "year", "week", "from_date")
    assert found == [(2024, 2, day("2024-01-08"))]
    # The step 2024-12-31 is named week 1 of 2024 and so describes the first week of that year, without billing.
    assert rows_of(capacity.staffing_and_billing_overview(t, day("2024-12-31"), day("2024-12-31"))) == []


# KPIs


def test_rolling_windows(spark, t):
    found = rows_of(kpi.kpi_fg(t, day("2024-02-01"), day("2024-03-01"), 1))
    # January: 22 weekdays with one holiday for 1 and 3, two days for 2; February has no billing.
    assert found == [(day("2024-01-01"), day("2024-01-31"), 7.5 / ((22 + 2 + 22) * 7.5 - 1.5) * 100)]


def test_prodev_and_development(spark, t):
    row = kpi.kpi_prodev(t, day("2024-02-01"), day("2024-02-01")).first()
    assert row.project_hours == 2.0
    assert kpi.kpi_product_development(t, day("2024-02-01"), day("2024-02-01")).first().payload == 2.0
    assert kpi.kpi_sick(t, day("2024-02-01"), day("2024-02-01")).first().payload is None


def test_visibility_reads_monday_of_the_iso_week(spark, make_tables):
    t = make_tables(
        reporting_visibility=[
            {"year": 2020, "week": 53, "available_hours": 200.0, "billable_hours": 50.0},
            {"year": 2021, "week": 1, "available_hours": 200.0, "billable_hours": 80.0},
        ]
    )
    assert rows_of(kpi.kpi_visibility(t, day("2020-12-28"), day("2021-01-03"))) == [(53, 2020, day("2020-12-28"), 25.0)]


@pytest.fixture(scope="module")
def invoiced(make_tables):
    def money(text):
        return Decimal(text)

    january, february = day("2024-01-31"), day("2024-02-29")
    return make_tables(
        projects=[{"id": "B"}, {"id": "N", "billable": "nonbillable"}, {"id": "Q"}],
        invoice_balance=[
            {"id": "i1", "project": "B", "date": january, "amount": money("1000.00"), "minutes": 100, "status": "ok"},
            {"id": "i2", "project": "B", "date": february, "amount": money("500.00"), "minutes": 59, "status": "sent"},
            {"id": "i3", "project": "N", "date": january, "amount": money("70.00"), "minutes": 61, "status": "ok"},
        ],
        write_off=[{"invoice_balance": "i1", "minutes": m} for m in (30, 15)],
        expense=[
            {"invoice_balance": "i1", "type": "other", "amount": money("10.00")},
            {"invoice_balance": "i1", "type": "other", "amount": money("20.00")},
            {"invoice_balance": "i1", "type": "subcontractor", "amount": money("100.00")},
            {"invoice_balance": "i1", "type": "subcontractor", "amount": money("200.00")},
            {"invoice_balance": "i1", "type": "subcontractor", "amount": money("300.00")},
            {"invoice_balance": "i3", "type": "other", "amount": money("5.00")},
        ],
        time_entry=[{"employee": 1, "project": "B", "date": january, "minutes": 120}],
        employees=[{"id": 1, "date_of_employment": day("2020-01-01")}],
    )


def test_hours_per_project_multiplies_siblings(spark, invoiced):
    year = Periods.single(spark, day("2024-01-01"), day("2024-12-31"))
    columns = ("project", "status", "time_entry_minutes", "write_off_minutes", "expense_money", "subcontractor_money")
    assert rows_of(kpi.hours_per_project(invoiced, year), *columns) == [
        ("B", "ok", 120, 45 * 6, 30.0 * 6, 600.0 * 4),
        ("B", "sent", 120, 0, 0.0, 0.0),
        ("Q", None, 0, 0, 0.0, 0.0),
    ]
    assert rows_of(kpi.hours_per_project(invoiced, year, fan_out=False), *columns)[0] == ("B", "ok", 120, 45, 30.0, 600.0)


def test_reconciliation_truncates_whole_hours(spark, invoiced):
    periods = Periods.of(spark, [(day("2024-01-01"), day("2024-12-31")), (day("2023-01-01"), day("2023-12-31"))])
    empty, full = rows_of(kpi.accumulated_reconciliation(invoiced, periods))
    assert full[2:] == (0.75, 3, 1570.0, 1570.0 - 635.0, 3, 2, 600.0, 35.0)
    assert empty[2:] == (None, None, None, None, 0, None, None, None)
    assert kpi.ot(invoiced, periods).first().ot == (1570.0 - 635.0) / 2.0


def test_summaries_add_rows_of_projects(spark, invoiced):
    row = kpi.monthly_balance_summary(invoiced, day("2024-02-01"), day("2024-02-01")).first()
    assert (row.invoice_money, row.subcontractor_money, row.time_entry_minutes) == (1000.0, 2400.0, 120.0)
    assert kpi.kpi_ul(invoiced, day("2024-02-01"), day("2024-02-01")).first().payload == 2.4


def test_customer_with_one_involved_employee(spark, make_tables):
    def work(employee, project, minutes):
        return {"employee": employee, "project": project, "date": day("2024-01-08"), "minutes": minutes}

    t = make_tables(
        employees=[{"id": i, "date_of_employment": day("2020-01-01")} for i in (1, 2, 5)],
        projects=[{"id": "X", "customer": "x"}, {"id": "Y", "customer": "y"}],
        time_entry=[work(1, "X", 300), work(2, "X", 100), work(1, "Y", 300), work(5, "Y", 400)],
    )
    period = Periods.single(spark, day("2024-01-08"), day("2024-01-08"))
    assert rows_of(kpi.unaccompanied_customer_involvement(t, period), "customer_id", "employee_count") == [("x", 1)]


def test_zero_divisor_fails_unless_safe(spark, make_tables):
    t = make_tables(
        employees=[{"id": 1, "date_of_employment": day("2020-01-01")}],
        projects=[{"id": "B"}, {"id": "FER1000", "billable": "unavailable"}],
        time_entry=[
            {"employee": 1, "project": p, "date": day("2024-01-08"), "minutes": 450} for p in ("B", "FER1000")
        ],
    )
    period = Periods.single(spark, day("2024-01-08"), day("2024-01-08"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        kpi.fg(t, period).collect()
    assert kpi.fg(t, period, safe=True).first().fg is None


def test_default_forms_fail_where_a_single_report_would(spark, make_tables):
    """Somebody employed on a weekend alone has no available hours; nor has a week before the first employment."""
    t = make_tables(
        employees=[{"id": 1, "date_of_employment": day("2024-01-06"), "termination_date": day("2024-01-07"), "has_permanent_position": True}],
        projects=[{"id": "B", "customer": "c"}],
        time_entry=[{"employee": 1, "project": "B", "date": day("2024-01-06"), "minutes": 60}],
    )
    bounds = (day("2024-02-01"), day("2024-02-01"))
    windows = Periods.month_windows(spark, *bounds, 2)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        kpi.unaccompanied_customer_involvement(t, windows).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        kpi.unaccompanied_customer_involvement_kpi(t, *bounds).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        capacity.weekly_forecasted_fg(t, day("2023-01-02"), day("2023-01-08")).collect()
    assert rows_of(kpi.unaccompanied_customer_involvement(t, windows, safe=True)) == []
    assert rows_of(kpi.unaccompanied_customer_involvement_kpi(t, *bounds, safe=True)) == []
    assert rows_of(capacity.weekly_forecasted_fg(t, day("2023-01-02"), day("2023-01-08"), safe=True)) == [("2023-01", None)]


# Vacation


def test_employee_years(spark, make_tables):
    t = make_tables(
        employees=[
            {"id": 1, "date_of_employment": day("2020-02-29"), "termination_date": day("2022-02-27")},
            {"id": 2, "date_of_employment": day("2023-12-01")},
            {"id": 3},
            {"id": 4, "date_of_employment": day("2025-01-01")},
        ]
    )
    as_of = dt.date(2024, 3, 1)
    assert rows_of(vacation.employee_years(t, as_of)) == [(1, 2020), (1, 2021), (1, 2022), (2, 2023), (2, 2024)]
    assert rows_of(vacation.employee_years(t, as_of, version=2)) == [(1, 2020), (1, 2021), (2, 2023)]
    assert rows_of(vacation.employee_years(t, dt.date(2024, 2, 28), version=1).filter("employee = 1"))[-1] == (1, 2024)


def test_vacation_account(spark, make_tables):
    t = make_tables(
        employees=[{"id": 1, "date_of_employment": day("2023-05-01")}],
        vacation_days=[{"employee_id": 1, "year": 2024, "days_earnt": 30.0}],
        time_entry=[{"employee": 1, "project": "FER1000", "date": day("2023-07-01"), "minutes": 900}],
    )
    assert rows_of(vacation.vacation_days_by_year(t, dt.date(2024, 1, 1))) == [(1, 2023, 25.0, 2.0), (1, 2024, 30.0, 0.0)]
