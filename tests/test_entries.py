from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shiftledger import Periods
from shiftledger.operators import dimensions, entries
from tests.conftest import day, in_order, rows_of

PROJECTS = [
    {"id": "B", "billable": "billable"},
    {"id": "N", "billable": "nonbillable"},
    {"id": "FER1000", "billable": "unavailable"},
    {"id": "SYK1002", "billable": "unavailable"},
    {"id": "PER1005", "billable": "billable"},
    {"id": "INT9", "billable": "nonbillable"},
    {"id": "ADM1000", "billable": "nonbillable"},
]
WEEK = (day("2024-01-08"), day("2024-01-14"))


def entry(employee, project, date, minutes, created=dt.datetime(2024, 2, 1)):
    return {"employee": employee, "project": project, "date": day(date), "minutes": minutes, "created": created}


def people(**more):
    return [
        {"id": 1, "first_name": "A", "last_name": "B", "email": "a@x", "date_of_employment": day("2023-01-01"), **more},
        {"id": 2, "first_name": "C", "last_name": "D", "email": "c@x", "date_of_employment": day("2024-01-10"), "role": "Annet"},
        {"id": 3, "first_name": "E", "last_name": "F", "email": "e@x", "termination_date": day("2024-01-09")},
        {"id": 4, "first_name": "G", "last_name": "H", "email": "g@x", "date_of_employment": day("2025-01-01")},
    ]


@pytest.fixture(scope="module")
def week(make_tables):
    return make_tables(
        employees=people(),
        customers=[{"id": "c", "name": "Customer"}],
        projects=PROJECTS,
        time_entry=[
            entry(1, "B", "2024-01-08", 450),
            entry(1, "N", "2024-01-09", 60, None),
            entry(1, "B", "2024-01-09", None),
            entry(1, "FER1000", "2024-01-10", 450),
            entry(1, "B", "2024-01-13", 120),
            entry(2, "ADM1000", "2024-01-11", 90),
            entry(3, "INT9", "2024-01-08", 61),
        ],
        staffing=[
            {"employee": 1, "project": "B", "date": day("2024-01-08"), "percentage": 50},
            {"employee": 2, "project": "N", "date": day("2024-01-12")},
        ],
        absence=[{"employee_id": 1, "date": day("2024-01-11"), "reason": "FER1000"}],
        holidays=[{"date": day("2024-01-12"), "name": "x"}],
    )


def test_status_with_staffing(spark, week):
    found = {r.id: r for r in entries.time_tracking_status_with_staffing(week, Periods.single(spark, *WEEK)).collect()}
    assert set(found) == {1, 2}  # 3 has no employment date, 4 starts later
    one = found[1]
    assert (one.available_hours, one.billable_hours, one.non_billable_hours, one.unavailable_hours) == (22.5, 9.5, 1.0, 7.5)
    assert (one.staffed_billable_hours, one.unavailable_absence_hours) == (3.75, 7.5)
    assert one.unregistered_days == 1  # Thursday; Friday is a holiday and Saturday does not count
    assert one.last_date == day("2024-01-13")
    assert one.last_created is None  # a missing creation time wins
    two = found[2]
    assert (two.available_hours, two.unregistered_days) == (15.0, 3)  # unregistered days are not cut to employment
    assert two.staffed_nonbillable_hours == 7.5


def test_long_overlapping_periods_agree_with_single_ones(spark, week):
    ranges = [(day("2024-01-01"), day("2024-03-31")), (day("2024-01-08"), day("2024-04-30")), WEEK]
    together = entries.time_tracking_status_with_staffing(week, Periods.of(spark, ranges))
    apart = [r for p in ranges for r in rows_of(entries.time_tracking_status_with_staffing(week, Periods.single(spark, *p)))]
    assert rows_of(together) == in_order(apart)


def test_periods_from_a_table_give_the_same_status(spark, week):
    table = Periods.from_table(spark.createDataFrame([WEEK], "from_date date, to_date date"))
    assert rows_of(entries.time_tracking_status(week, table)) == rows_of(
        entries.time_tracking_status(week, Periods.single(spark, *WEEK))
    )


def test_one_class_has_a_row_only_with_entries_and_null_minutes_stay_null(spark, week):
    period = Periods.single(spark, day("2024-01-09"), day("2024-01-09"))
    assert rows_of(entries.billable_hours_for_employees(week, period), "id", "sum") == [(1, None)]
    assert rows_of(entries.unavailable_hours_for_employees(week, period)) == []


def test_unregistered_days_match_the_set_difference(spark, week):
    found = rows_of(entries.unregistered_days(week, Periods.single(spark, *WEEK)), "employee", "unregistered_days")
    assert found == [(1, 1), (2, 3), (3, 3), (4, 4)]


def test_overtime(spark, week, make_tables):
    t = week.replace(
        paid_overtime=make_tables(
            paid_overtime=[
                {"employee": 2, "paid_date": day("2024-01-12"), "minutes": 30},
                {"employee": 2, "paid_date": None, "minutes": 600},
            ]
        ).paid_overtime
    )
    asked = spark.createDataFrame([(2, day("2024-01-12")), (3, day("2024-01-12"))], "employee int, end_date date")
    found = rows_of(entries.accumulated_overtime(t, asked, reject=True))
    assert found == [(2, day("2024-01-12"), 1.5 - 15.0 - 0.5, False), (3, day("2024-01-12"), None, True)]
    with pytest.raises(Exception, match="end date after employee termination date"):
        entries.accumulated_overtime(t, asked).collect()


def test_entries_with_project_has_a_row_for_an_empty_day(spark, week):
    found = rows_of(entries.entries_with_project(week, day("2024-01-11"), day("2024-01-11")).filter("for_employee < 3"))
    assert found == [
        (1, day("2024-01-11"), None, None, None),
        (2, day("2024-01-11"), 2, "ADM1000", 1.5),
    ]


def test_hours_per_employee_json_keeps_empty_days(spark, week):
    rows = {r.name: json.loads(r.hours) for r in entries.hours_per_employee_json(week, day("2024-01-08"), day("2024-01-10")).collect()}
    assert rows["A B"] == [{"2024-01-08": 7.5}, {"2024-01-09": 1.0}, {"2024-01-10": 7.5}]
    assert rows["E F"] == [{"2024-01-08": 1.0}, {"2024-01-09": None}, {"2024-01-10": None}]
    with pytest.raises(ValueError, match="366"):
        entries.hours_per_employee(week, day("2024-01-01"), day("2025-01-02"))


def test_whole_hours_are_truncated(spark, week):
    found = rows_of(entries.accumulated_entries_on_project(week, Periods.single(spark, *WEEK)), "project", "hours")
    assert ("ADM1000", 1) in found and ("INT9", 1) in found and ("B", 9) in found


def test_time_distribution_counts_rows(spark, week):
    periods = Periods.of(spark, [WEEK, (day("2020-01-01"), day("2020-01-02"))])
    found = rows_of(entries.time_distribution(week, periods), "billable_hours", "nonbillable_hours", "unavailable_hours")
    assert found == [(None, None, None), (22.5, 22.5, 7.5)]


def test_bonus_counts_a_billable_bonus_code_twice(spark, week, make_tables):
    t = week.replace(time_entry=make_tables(time_entry=[entry(1, "PER1005", "2024-01-08", 60)]).time_entry)
    found = entries.bonus_hours_for_employees(t, Periods.single(spark, *WEEK)).filter("employee = 1").first()
    assert found.bonus_billable_hours == 2.0


def test_yearly_bonus_tiers(spark, make_tables):
    workweek = [f"2024-02-{d:02d}" for d in range(5, 10)]
    t = make_tables(
        employees=people(),
        projects=PROJECTS,
        time_entry=[entry(1, "B", d, 450) for d in workweek]
        + [entry(1, "B", f"2024-02-{d}", m) for d, m in zip(range(12, 17), (450, 450, 450, 450, 300))],
        employee_tenure_role=[
            {"employee_id": 1, "from_date": day("2024-02-11"), "to_date": day("2024-02-12")},
        ],
    )
    found = dict(rows_of(entries.employee_yearly_bonus(t, 2024), "employee", "bonus"))
    # The role touches the first week on its Sunday and the second on its Monday.
    assert found == {1: 1000 + 750, 2: 0, 3: 0, 4: 0}


def test_weekly_fg_has_all_weeks(spark, week):
    found = entries.employee_weekly_fg(week, 2020)
    assert found.filter("employee = 1").count() == 53


def test_periodic_report(spark, week):
    found = dict(rows_of(entries.periodic_report(week, Periods.single(spark, *WEEK)), "prosjekt", "timer"))
    assert found["Internsystemer"] == 1.02
    assert found["Ferie"] == 7.5
    assert found["Fakturerbart"] == 9.5
    assert found["Totalt tilgjengelig"] == 37.5
    assert found["Admin og Salg ført av admin/ledelse"] == 1.5
    assert found["Admin ført av andre"] is None  # employee 1 has no role
    assert "Sykt barn" not in found and found["Sykdom (inkl barn)"] is None


def test_sums_in_the_half_open_range(spark, week):
    found = rows_of(entries.entries_sums(week, day("2024-01-08"), 2).filter("employee = 1"), "date", "sum")
    assert found == [(day("2024-01-08"), 450), (day("2024-01-09"), 60)]


# Dimensions


def test_absence_reasons_add_the_constant_row(week):
    assert rows_of(dimensions.absence_reasons(week), "id") == [("AVS",), ("FER1000",), ("SYK1002",)]


def test_absence_spent_needs_minutes(week, make_tables):
    t = week.replace(time_entry=make_tables(time_entry=[entry(1, "FER1000", "2024-01-10", 0), entry(1, "SYK1002", "2024-01-10", 30)]).time_entry)
    assert rows_of(dimensions.absence_spent(t), "reason", "minutes") == [("SYK1002", 30)]


def test_roles_keep_repeats_and_are_empty_without_any(week, make_tables):
    t = week.replace(employee_role=make_tables(employee_role=[{"employee_id": 1, "role_type": "admin"}] * 2).employee_role)
    found = {r.employee.id: r.roles for r in dimensions.employees_roles(t).collect()}
    assert found[1] == ["admin", "admin"] and found[2] == []
    by_email = dimensions.employees_roles(t, t.employees.filter("id = 2").select("email")).collect()
    assert [r.employee.id for r in by_email] == [2]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[2024-01-08,2024-01-10)", ["B", "N"]),
        ("(2024-01-08,2024-01-10]", ["B", "FER1000", "N"]),
        ("[2024-01-10,)", ["B", "FER1000"]),
        ("(,2024-01-08]", ["B"]),
        ("(2024-01-09,2024-01-10)", []),
        ("empty", []),
        (None, []),
    ],
)
def test_projects_in_a_textual_range(spark, week, text, expected):
    asked = spark.createDataFrame([(1, text)], "employee int, date_range string")
    assert [r[0] for r in rows_of(dimensions.projects_info_for_employee_in_range(week, asked), "id")] == expected


def test_malformed_range_fails(spark, week):
    asked = spark.createDataFrame([(1, "2024-01-01")], "employee int, date_range string")
    with pytest.raises(Exception, match="malformed range"):
        dimensions.projects_info_for_employee_in_range(week, asked).collect()


def test_employees_on_projects_excludes_both_bounds(spark, week):
    inside = Periods.single(spark, day("2024-01-07"), day("2024-01-09"))
    on_bound = Periods.single(spark, day("2024-01-08"), day("2024-01-09"))
    assert rows_of(dimensions.employees_on_projects(week, inside), "id", "customer_name") == [(1, "Customer")]
    assert rows_of(dimensions.employees_on_projects(week, on_bound)) == []


def test_number_of_employees(spark, week):
    periods = Periods.of(spark, [WEEK, (day("2022-01-01"), day("2022-01-02"))])
    assert rows_of(dimensions.number_of_employees_in_periods(week, periods), "employee_count") == [(0,), (2,)]


def test_project_responsible_breaks_ties_by_project(spark, make_tables):
    t = make_tables(
        projects=[
            {"id": "P1", "responsible": 7},
            {"id": "P2", "responsible": 8},
            {"id": "FER1000", "responsible": 9},
            {"id": "OLD", "responsible": 6, "active": False},
        ],
        staffing=[
            {"employee": 1, "project": p, "date": day(d)}
            for p, d in [("P2", "2024-01-10"), ("P1", "2024-01-11"), ("FER1000", "2024-01-11"), ("FER1000", "2024-01-12")]
            + [("OLD", f"2024-01-{n}") for n in range(10, 15)]
        ],
    )
    assert rows_of(dimensions.employee_project_responsible(t, day("2024-01-15"))) == [(1, 7)]
    older = dimensions.employee_project_responsible(t, day("2024-01-15"), 15, 14, ())
    assert rows_of(older) == [(1, 9)]
    at_noon = dimensions.employee_project_responsible(t, dt.datetime(2024, 2, 1, 12))
    assert rows_of(at_noon) == [(1, 7)]  # after 2024-01-10 12:00, so only the 11th is left


def test_projects_for_dates_combine_sources(spark, week):
    t = week.replace(
        staffing=week.staffing.unionByName(
            spark.createDataFrame([(1, "FER1000", day("2024-01-11"), 40)], week.staffing.schema)
        )
    )
    found = {(r.date.day, r.id): r for r in dimensions.projects_for_employee_dates(t, Periods.single(spark, *WEEK)).filter("employee = 1").collect()}
    assert (found[8, "B"].minutes, found[8, "B"].percentage_staffed) == (450, 50)
    # Staffed and absent on the same code: only the staffed percentage counts.
    assert found[11, "FER1000"].percentage_staffed == 40
    assert found[11, "FER1000"].customer == "Customer"
    alone = dimensions.projects_for_employee_dates(week, Periods.single(spark, *WEEK)).filter("employee = 1 AND id = 'FER1000'")
    assert rows_of(alone, "date", "customer", "minutes", "percentage_staffed") == [
        (day("2024-01-10"), "Customer", 450, 0),
        (day("2024-01-11"), "Internt", 0, 100),
    ]


def test_sick_child_days(week):
    assert not any(r.has_sick_child_days for r in dimensions.employee_has_sick_child_days(week).collect())


def test_available_projects_leave_out_absence_codes(week):
    found = {r.id: r.customer.name for r in dimensions.available_projects(week).collect()}
    assert "FER1000" not in found and found["B"] == "Customer"


def test_class_flag_round_trip(spark):
    from shiftledger.operators.changes import billable_class_to_flag, billable_flag_to_class

    flags = spark.createDataFrame([(True,), (False,), (None,)], "billable boolean")
    assert [r[0] for r in billable_flag_to_class(flags).collect()] == ["billable", "nonbillable", "nonbillable"]
    assert [r[0] for r in billable_class_to_flag(billable_flag_to_class(flags)).collect()] == [True, False, False]


def test_emoji_rule(spark):
    from shiftledger.functions.codes import is_emoji

    values = spark.createDataFrame([("\U0001f600",), ("a",), ("\U0001f600\U0001f600",), ("",), (None,)], "v string")
    assert [r[0] for r in values.select(is_emoji(F.col("v"))).collect()] == [True, False, False, False, True]
