
from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosscheck.derived import HOLIDAYS, booked_code, contract_tables, derived_tables, scratch
from shiftledger import Periods, Tables
from shiftledger.functions import codes, dates
from shiftledger.operators import calendar, capacity, changes, contracts, dimensions, entries, kpi, vacation
from shiftledger.plans.periods import iso_week_windows, month_windows, year_to_date_windows
from shiftledger.plans.rollup import read_rollup
from shiftledger.sources.months import apply_change, refresh_rollup, stage_change, store_rollup, write_months

START, END = dt.date(1995, 2, 1), dt.date(2001, 12, 1)
YEAR = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))
WHOLE = (dt.date(1995, 1, 1), dt.date(2001, 11, 30))
MIXED = (dt.date(1995, 1, 1), dt.date(2001, 11, 20))
# All weeks have employees.
HIRED = (dt.date(1997, 1, 6), dt.date(2001, 11, 20))
AS_OF = dt.date(1998, 6, 15)
LAST_DAY = dt.date(2001, 11, 4)

Query = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function: Query):
        return lambda spark, folder: function(derived_tables(spark, folder))

    return {name: bind(function) for name, function in _QUERIES.items()}


def months(t: Tables) -> Periods:
    """One period per calendar month of the data."""
    return Periods.month_windows(t.spark, START, END, 1)


def by_month(name: str, operator: Callable[[Tables, Periods], DataFrame]) -> None:
    """Register an operator that takes periods, asked for every month."""
    _QUERIES[name] = lambda t: operator(t, months(t))


def in_range(name: str, operator, first: dt.date = START, last: dt.date = END) -> None:
    """Register an operator that takes a start and an end date."""
    _QUERIES[name] = lambda t: operator(t, first, last)


# A: calendar


@query("a1_is_weekday")
def _(t):
    return t.time_entry.groupBy(dates.is_weekday(F.col("date")).alias("weekday")).agg(F.count("*").alias("entries"))


@query("a2_is_holiday")
def _(t):
    return calendar.only_holidays(t.time_entry, t.holidays).groupBy("date").agg(F.count("*").alias("entries"))


@query("a3_week_dates")
def _(t):
    weeks = t.staffing.select(F.year("date").alias("year"), F.weekofyear("date").alias("week")).distinct()
    return calendar.week_dates(weeks)


@query("a4_is_date_in_week")
def _(t):
    created = F.col("created")
    same = dates.is_date_in_week(F.col("date"), F.year(created), F.weekofyear(created))
    return t.time_entry.groupBy("employee", same.alias("same_week")).agg(F.count("*").alias("entries"))


def _employments(t: Tables) -> DataFrame:
    return t.employees.select(
        F.col("id").alias("employee"),
        F.col("date_of_employment").alias("start"),
        F.coalesce("termination_date", F.lit(LAST_DAY)).alias("end"),
    )


@query("a5_available_dates")
def _(t):
    intervals = _employments(t).select(F.col("start").alias("from_date"), F.col("end").alias("to_date"))
    periods = Periods.from_table(intervals, dt.date(1995, 1, 1), LAST_DAY)
    return (
        calendar.available_dates_in_periods(periods, t.holidays)
        .groupBy("from_date", "to_date")
        .agg(
            F.count("*").alias("available"),
            F.min("available_date").alias("first_date"),
            F.max("available_date").alias("last_date"),
        )
    )


@query("a6_business_hours")
def _(t):
    ranges = t.time_entry.select("employee", "date", F.to_date("created").alias("until"))
    return (
        calendar.business_hours(ranges, F.col("date"), F.col("until"), t.holidays)
        .groupBy("employee")
        .agg(F.sum("business_hours").alias("business_hours"))
    )


@query("a7_month_dates")
def _(t):
    return _employments(t).select("employee", F.inline(month_windows(F.col("start"), F.col("end"), 6)))


@query("a8_accumulated_date_periods")
def _(t):
    windows = year_to_date_windows(F.col("start"), F.col("end"))
    return _employments(t).select("employee", F.inline(windows).alias("start_date", "end_date"))


@query("a9_iso_weeks_of_year")
def _(t):
    days = t.time_entry.groupBy("date").agg(F.count("*").alias("n"))
    years = days.select(F.year("date").alias("year")).distinct()
    weeks = years.select(F.inline(iso_week_windows(F.col("year"))))
    counted = days.groupBy(dates.week_start(F.col("date")).alias("from_date")).agg(F.sum("n").alias("entries"))
    return weeks.join(counted, "from_date", "left").select(
        F.col("iso_year").alias("year"), "week_number", F.col("from_date").alias("week_start"), "entries"
    )


@query("a10_holidays_dimension")
def _(t):
    named = calendar.holidays_dimension(t.spark, *HOLIDAYS, break_years=(1997, 2000))
    counted = t.time_entry.groupBy("date").agg(F.count("*").alias("entries"))
    return named.join(counted, "date", "left").select("date", "name", F.coalesce("entries", F.lit(0)).alias("entries"))


# B: dimensions


@query("b1_is_absence_reason")
def _(t):
    reason = codes.is_absence_reason(F.col("project")).alias("is_reason")
    return t.time_entry.groupBy(reason).agg(F.count("*").alias("entries"), F.sum("minutes").alias("minutes"))


query("b2_absence_reasons")(dimensions.absence_reasons)
query("b3_absence_spent")(dimensions.absence_spent)


@query("b4_available_projects")
def _(t):
    return dimensions.available_projects(t).select(
        "id",
        "name",
        "billable",
        "active",
        F.col("customer.id").alias("customer_id"),
        F.col("customer.name").alias("customer_name"),
    )


def _roles(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("employee.id").alias("id"), F.col("employee.email").alias("email"), F.concat_ws(",", "roles").alias("roles")
    )


@query("b5a_employees_roles_by_id")
def _(t):
    return _roles(dimensions.employees_roles(t, t.absence.select(F.col("employee_id").alias("id")).distinct()))


@query("b5b_employees_roles")
def _(t):
    return _roles(dimensions.employees_roles(t))


@query("b5c_employees_roles_by_email")
def _(t):
    return _roles(dimensions.employees_roles(t, t.employees.filter("termination_date IS NOT NULL").select("email")))


by_month("b6_employees_in_dates", dimensions.employees_in_periods)


@query("b7_projects_info_for_employee_in_period")
def _(t):
    start, end = F.col("start").cast("string"), F.date_add("start", 400).cast("string")
    kind = F.col("employee") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("["), start, F.lit(","), end, F.lit(")")))
        .when(kind == 1, F.concat(F.lit("("), start, F.lit(", "), end, F.lit("]")))
        .when(kind == 2, F.concat(F.lit("["), end, F.lit(",)")))
        .otherwise(F.concat(F.lit("(,"), end, F.lit("]")))
    )
    return dimensions.projects_info_for_employee_in_range(t, _employments(t).select("employee", text.alias("date_range")))


by_month("b8_employees_on_projects", dimensions.employees_on_projects)


@query("b9a_employee_project_responsible_v1")
def _(t):
    return dimensions.employee_project_responsible(t, AS_OF, days_back=15, days_ahead=14, exclude=())


@query("b9b_employee_project_responsible")
def _(t):
    return dimensions.employee_project_responsible(t, AS_OF)


by_month("b10_number_of_employees_in_period", dimensions.number_of_employees_in_periods)
query("b11_employee_has_sick_child_days")(dimensions.employee_has_sick_child_days)


@query("b12_projects_for_employee_for_date")
def _(t):
    return dimensions.projects_for_employee_dates(t, Periods.single(t.spark, START, END))


# C: time entries

by_month("c1_accumulated_hours_for_employee", entries.accumulated_hours)


@query("c2_accumulated_overtime_for_employee")
def _(t):
    asked = t.employees.select(
        F.col("id").alias("employee"), F.explode(F.array(F.lit(AS_OF), F.lit(WHOLE[1]))).alias("end_date")
    )
    return entries.accumulated_overtime(t, asked, reject=True, last=WHOLE[1])


@query("c2_accumulated_overtime_failing_form")
def _(t):
    """As the reference answers: an end date after the termination would be an error, so none is asked for."""
    end = F.least(F.coalesce("termination_date", F.lit(WHOLE[1])), F.lit(WHOLE[1])).alias("end_date")
    return entries.accumulated_overtime(t, t.employees.select(F.col("id").alias("employee"), end), last=WHOLE[1])


in_range("c3_entries_sums_with_project", entries.entries_with_project, *WHOLE)


@query("c4_entries_sums_for_employee")
def _(t):
    return entries.entries_sums(t, dt.date(1995, 1, 2), 2530)


@query("c5_hours_per_employee")
def _(t):
    """One call answers 366 days at most, so there is one for each year."""
    years = [entries.hours_per_employee(t, dt.date(y, 1, 1), dt.date(y, 12, 31)) for y in range(1995, 2002)]
    return reduce(DataFrame.unionByName, years).select("id", "name", F.inline("hours"))


@query("c5_hours_per_employee_json")
def _(t):
    return entries.hours_per_employee_json(t, *YEAR)


by_month("c6_accumulated_entries_on_project", entries.accumulated_entries_on_project)
by_month("c7_unavailable_hours_for_employees", entries.unavailable_hours_for_employees)
by_month("c8_billable_hours_for_employees", entries.billable_hours_for_employees)
by_month("c9_nonbillable_hours_for_employees", entries.nonbillable_hours_for_employees)
by_month("c10_unregistered_days", entries.unregistered_days)
by_month("c11_time_tracking_status", entries.time_tracking_status)


def _months_of_data(t: Tables) -> Periods:
    """The same months, found in a table, so that neither their number nor their bounds are known."""
    return Periods.from_table(months(t).df)


@query("c11_time_tracking_status_period_table")
def _(t):
    return entries.time_tracking_status(t, _months_of_data(t))


def of_period_table(name: str, operator: Callable[[Tables, Periods], DataFrame]) -> None:
    _QUERIES[f"{name}_period_table"] = lambda t: operator(t, _months_of_data(t))


of_period_table("b6_employees_in_dates", dimensions.employees_in_periods)
of_period_table("c1_accumulated_hours_for_employee", entries.accumulated_hours)
of_period_table("c10_unregistered_days", entries.unregistered_days)


by_month("c12_time_tracking_status_with_staffing", entries.time_tracking_status_with_staffing)


def _refreshed_rollup(t: Tables) -> Tables:
    """The tables with a stored roll-up: made when the entries of two months were not there yet, then refreshed for
    those months."""
    path = f"{scratch(t.spark)}/entry_rollup"
    late = F.date_format("date", "yyyy-MM").isin("1997-03", "1999-10")
    store_rollup(t.replace(time_entry=t.time_entry.filter(~late)), path)
    refresh_rollup(t, path, [199703, 199910])
    return read_rollup(t, path)


@query("c12_time_tracking_status_with_staffing_from_rollup")
def _(t):
    return entries.time_tracking_status_with_staffing(_refreshed_rollup(t), months(t))


in_range("c13_time_tracking_status_by_week", entries.time_tracking_status_by_week)
by_month("c14_fg_for_employee", entries.fg_for_employees)
by_month("c15_bonus_hours_for_employee", entries.bonus_hours_for_employees)


@query("c16_employee_yearly_bonus")
def _(t):
    return entries.employee_yearly_bonus(t, 1995, 2001)


@query("c17_employee_weekly_fg")
def _(t):
    return entries.employee_weekly_fg(t, 1995, 2001)


by_month("c18_time_distribution", entries.time_distribution)


@query("c19_total_hours_on_project_in_period")
def _(t):
    return entries.total_hours_on_project(t, months(t), "FAG1000")


by_month("c20_sick_hours", entries.sick_hours)
by_month("c21_unavailable_time_entry_hours", entries.unavailable_time_entry_hours)
by_month("c22_product_development_hours", entries.product_development_hours)
by_month("c23_get_periodic_report", entries.periodic_report)

# D: capacity

by_month("d1_staffed_billable_hours_for_employees", capacity.staffed_billable_hours_for_employees)
by_month("d2_staffed_nonbillable_hours_for_employees", capacity.staffed_nonbillable_hours_for_employees)
by_month("d3_unavailable_absence_days_for_employees", capacity.unavailable_absence_days_for_employees)
query("d4_staffed_hours")(capacity.staffed_hours)


@query("d5_available_dates")
def _(t):
    asked = t.staffing.select("employee", F.year("date").alias("year"), F.weekofyear("date").alias("week")).distinct()
    return capacity.available_dates(t, asked)


def _projects_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("projects", F.concat_ws(",", "projects"))


@query("d6_worked_days_per_week")
def _(t):
    return _projects_text(capacity.worked_days_per_week(t, dt.date(1995, 1, 1), 362))


@query("d7_employee_worked_days_per_week")
def _(t):
    return _projects_text(capacity.employee_worked_days_per_week(t, dt.date(1995, 1, 2), 362))


@query("d8_get_weekly_staffing_dates")
def _(t):
    days = F.concat_ws(",", F.transform("days", lambda d: d.cast("string")))
    return capacity.weekly_staffing_dates(t, START, END).withColumn("days", days)


@query("d9_get_weekly_staffing")
def _(t):
    return capacity.weekly_staffing(t, *MIXED).select(
        "employee_id",
        "first_name",
        "last_name",
        "role",
        "project",
        "project_name",
        "billable",
        "week",
        F.col("availability").cast("double").alias("availability"),
        F.explode_outer("dates").alias("date", "percentage"),
    )


@query("d9_get_weekly_staffing_json")
def _(t):
    """The documents, read back from their text."""
    kind = "id int, name string, role string, imageUrl string, subRows array<map<string, string>>"
    read = capacity.weekly_staffing_document(t, *MIXED).select(F.from_json("document", kind).alias("d")).select("d.*")
    rows = read.select("id", "name", "role", F.col("imageUrl").alias("image_url"), F.explode_outer("subRows").alias("row"))
    fixed = F.array(*map(F.lit, ("name", "billable", "project_name")))
    weeks = F.filter(F.map_entries("row"), lambda e: ~F.array_contains(fixed, e["key"]))
    cells = rows.select("*", F.explode_outer(weeks).alias("w")).select(
        "*", F.from_json("w.value", "dates map<string, int>, availability double").alias("week_data")
    )
    return cells.select(
        "id", "name", "role", "image_url",
        F.col("row")["name"].alias("project"),
        F.col("row")["billable"].alias("billable"),
        F.col("row")["project_name"].alias("project_name"),
        F.col("w.key").alias("week"),
        F.col("week_data.availability").alias("availability"),
        F.explode_outer("week_data.dates").alias("date", "percentage"),
    )


@query("d10_availability_percentage")
def _(t):
    return capacity.availability_percentage(t, months(t)).withColumn("availability", F.col("availability").cast("double"))


@query("d10_availability_percentage_of_employee")
def _(t):
    rows = capacity.employee_availability_percentage(t, months(t))
    return rows.withColumn("availability", F.col("availability").cast("double"))


@query("d10_availability_percentage_period_table")
def _(t):
    rows = capacity.availability_percentage(t, _months_of_data(t))
    return rows.withColumn("availability", F.col("availability").cast("double"))


@query("d11_weekly_availability")
def _(t):
    rows = capacity.weekly_availability(t, *MIXED)
    return rows.withColumn("availability", F.col("availability").cast("double"))


in_range("d11_weekly_availability_json", capacity.weekly_availability_json, *MIXED)
in_range("d12_weekly_forecasted_fg_json", capacity.weekly_forecasted_fg_json, *HIRED)
in_range("d12_weekly_forecasted_fg_failing_form", capacity.weekly_forecasted_fg, *HIRED)
in_range("d13_weekly_fg_json", capacity.weekly_fg_json, *MIXED)
# Safe: no hours are available in the weeks before the first employment.
_QUERIES["d12_weekly_forecasted_fg"] = lambda t: capacity.weekly_forecasted_fg(t, *MIXED, safe=True)
in_range("d13_weekly_fg", capacity.weekly_fg, *MIXED)
by_month("d14_unavailable_staffing_hours", capacity.unavailable_staffing_hours)
by_month("d15_planned_billable_hours", capacity.planned_billable_hours)
by_month("d16_forcasted_fg_in_period", capacity.forecasted_fg)
by_month("d17_unavailable_staffing_dates_in_period", capacity.unavailable_staffing_dates)


@query("d18_all_employee_work_dates_in_period")
def _(t):
    return capacity.all_employee_work_dates(t, Periods.single(t.spark, *WHOLE))


by_month("d19_all_absence_dates_in_period", capacity.all_absence_dates)
by_month("d20_forcasted_available_hours", capacity.forecasted_available_hours)


@query("d21_is_possible_work_day")
def _(t):
    return capacity.is_possible_work_day(t, t.time_entry.select("employee", "date").distinct())


@query("d22_possible_work_dates_per_employee")
def _(t):
    return capacity.possible_work_dates_per_employee(t, Periods.single(t.spark, *WHOLE))


by_month("d23_accumulated_staffing_hours", capacity.accumulated_staffing_hours)
in_range("d24_staffing_and_billing_overview", capacity.staffing_and_billing_overview, *MIXED)

# E: KPIs and finance

by_month("e1_fg", kpi.fg)
in_range("e2_kpi_fg", kpi.kpi_fg)


@query("e2_kpi_fg_from_rollup")
def _(t):
    return kpi.kpi_fg(_refreshed_rollup(t), START, END)


in_range("e3_kpi_product_development", kpi.kpi_product_development)
in_range("e4_kpi_sick", kpi.kpi_sick)
in_range("e5_kpi_ul", kpi.kpi_ul)
by_month("e6_sum_business_hours", capacity.sum_business_hours)
by_month("e7_accumulated_billed_hours", capacity.accumulated_billed_hours)


@query("e7_accumulated_billed_hours_period_table")
def _(t):
    return capacity.accumulated_billed_hours(t, _months_of_data(t))


in_range("e8_kpi_prodev", kpi.kpi_prodev)
in_range("e9_kpi_fgdev", kpi.kpi_fgdev, dt.date(1995, 3, 31), END)
in_range("e10_kpi_visibility", kpi.kpi_visibility)
by_month("e11_accumulated_reconciliation", kpi.accumulated_reconciliation)
by_month("e12_ot", kpi.ot)
in_range("e13_ot_rolling", kpi.ot_rolling)
in_range("e14_kpi_accumulated_fg", kpi.kpi_accumulated_fg)
in_range("e15_kpi_accumulated_ot", kpi.kpi_accumulated_ot)


@query("e16_unaccompanied_customer_involvement_in_period")
def _(t):
    return kpi.unaccompanied_customer_involvement(t, Periods.month_windows(t.spark, START, END, 2), safe=True)


@query("e17_unaccompanied_customer_involvement_kpi")
def _(t):
    return kpi.unaccompanied_customer_involvement_kpi(t, START, END, safe=True)


in_range("e18_monthly_balance_summary", kpi.monthly_balance_summary)


@query("e19_hours_per_project")
def _(t):
    return kpi.hours_per_project(t, Periods.month_windows(t.spark, dt.date(1996, 1, 1), END, 12))


@query("e19_hours_per_project_period_table")
def _(t):
    return kpi.hours_per_project(t, Periods.from_table(Periods.month_windows(t.spark, dt.date(1996, 1, 1), END, 12).df))


@query("e19_hours_per_project_counted_once")
def _(t):
    periods = Periods.month_windows(t.spark, dt.date(1996, 1, 1), END, 12)
    return kpi.hours_per_project(t, periods, fan_out=False)


# F: vacation


@query("f1a_employee_years_v1")
def _(t):
    return vacation.employee_years(t, LAST_DAY, version=1)


@query("f1b_employee_years_v2")
def _(t):
    return vacation.employee_years(t, LAST_DAY, version=2)


@query("f1c_employee_years")
def _(t):
    return vacation.employee_years(t, LAST_DAY)


@query("f2_vacation_days_earnt")
def _(t):
    return vacation.vacation_days_earnt(t, LAST_DAY)


@query("f3_vacation_days_spent")
def _(t):
    return vacation.vacation_days_spent(t, LAST_DAY)


@query("f4_vacation_days_by_year")
def _(t):
    return vacation.vacation_days_by_year(t, LAST_DAY)


# G: changes. Requests come from the orders, every order being one.


def _orders(t: Tables) -> DataFrame:
    """Half of the requests are about ten employees, the others about all of them."""
    staff = t.employees.agg(F.count("*").alias("_staff"))
    of_all = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 10).otherwise(F.col("o_custkey") % F.col("_staff"))
    return t.orders.crossJoin(F.broadcast(staff)).select(
        F.col("o_orderkey").cast("int").alias("seq"),
        of_all.cast("int").alias("employee"),
        booked_code(F.col("o_orderkey") % 200).alias("project"),
        F.to_date("o_orderdate").alias("start_date"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 20 - 1).cast("int")).alias("end_date"),
        F.when(F.col("o_totalprice") > 200000, 50).otherwise(80).alias("percentage"),
        F.year("o_orderdate").alias("year"),
        F.weekofyear("o_orderdate").alias("week"),
        (F.col("o_custkey") % 4).cast("int").alias("days"),
        F.last_day(F.date_add(F.to_date("o_orderdate"), 20)).alias("date"),
        (F.col("o_custkey") % 90).cast("int").alias("minutes"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "sent").otherwise("not_ok").alias("status"),
        F.when(F.col("o_custkey") % 2 == 0, "subcontractor").otherwise("other").alias("type"),
    )


def _ranges(t: Tables) -> DataFrame:
    return _orders(t).select("seq", "employee", "project", "start_date", "end_date", "percentage")


def _week_requests(t: Tables) -> DataFrame:
    return _orders(t).select("seq", "employee", "project", "year", "week", "days")


def _staffing_outcome(change: changes.Change) -> DataFrame:
    """New tables and reported rows of a staffing change in one table."""
    none = F.lit(None).cast("int")
    parts = [
        change.tables["staffing"].select(
            F.lit("staffing").alias("part"), none.alias("seq"), "employee", "project", "date", "percentage"
        ),
        change.returned.select(
            F.lit("returned").alias("part"), "seq", "employee", "project", "date", none.alias("percentage")
        ),
    ]
    if "absence" in change.tables:
        parts.append(
            change.tables["absence"].select(
                F.lit("absence").alias("part"),
                none.alias("seq"),
                F.col("employee_id").alias("employee"),
                F.col("reason").alias("project"),
                "date",
                "percentage",
            )
        )
    if change.rejected is not None:
        parts.append(
            change.rejected.select(
                F.lit("rejected").alias("part"),
                "seq",
                "employee",
                "project",
                F.col("start_date").alias("date"),
                none.alias("percentage"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def staffing_change(name: str, operator, requests: Callable[[Tables], DataFrame]) -> None:
    _QUERIES[name] = lambda t: _staffing_outcome(operator(t, requests(t)))


staffing_change("g1_add_staffing_in_period", changes.add_staffing_in_period, _ranges)
staffing_change("g2_remove_staffing_in_period", changes.remove_staffing_in_period, _ranges)
staffing_change("g3_insert_staffing", changes.insert_staffing, _ranges)
staffing_change("g4_upsert_staffing", changes.upsert_staffing, _ranges)


@query("g4_upsert_staffing_stored_by_month")
def _(t):
    """The batch applied to stored tables, twice: the months it touches are replaced, the second time none. The batch
    is stored, too, in parts of like size, since each step reads its requests."""
    folder = scratch(t.spark)
    write_months(t.staffing, f"{folder}/staffing")
    batch = _ranges(t).repartition("seq")
    batch.write.parquet(f"{folder}/_requests")
    asked = t.spark.read.schema(batch.schema).parquet(f"{folder}/_requests")
    stored = t.replace(staffing=t.spark.read.parquet(f"{folder}/staffing"))
    first = apply_change(changes.upsert_staffing(stored, asked), folder)
    after = t.replace(staffing=t.spark.read.parquet(f"{folder}/staffing"))
    second = stage_change(changes.upsert_staffing(after, asked), folder)
    if second.months["staffing"]:
        raise AssertionError(f"a batch that was applied changes {second.months}")
    return _staffing_outcome(changes.Change({"staffing": after.staffing}, first.returned, first.rejected))


@query("g5_remove_staffing_range")
def _(t):
    asked = _ranges(t).withColumn("end_date", F.when(F.col("percentage") == 80, F.col("end_date")))
    return _staffing_outcome(changes.remove_staffing(t, asked))


staffing_change("g6_add_staffing_week", changes.add_staffing_in_week, _week_requests)


@query("g7_remove_staffing_week")
def _(t):
    asked = t.staffing.groupBy("employee", "project", F.year("date").alias("year"), F.weekofyear("date").alias("week")).agg(
        F.max(F.dayofmonth("date")).alias("last"), F.max((F.col("percentage") / 50).cast("int")).alias("days")
    )
    # two requests for each week, of which the second takes a day that the first leaves
    turns = asked.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "employee", "project", "year", "week",
        (F.col("last") * 2 + F.col("turn")).alias("seq"),
        F.when(F.col("turn") == 0, F.col("days")).otherwise(1).alias("days"),
    )
    return _staffing_outcome(changes.remove_staffing_in_week(t, turns))


@query("g8_fix_staffing_on_weekends_and_holidays")
def _(t):
    change = changes.fix_staffing_on_weekends_and_holidays(t)
    none = F.lit(None).cast("int")
    staffing = change.tables["staffing"].select(
        "employee", "project", "date", "percentage", none.alias("year"), none.alias("week"), none.alias("count")
    )
    stuck = change.returned.select(
        "employee", "project", F.lit(None).cast("date").alias("date"), none.alias("percentage"), "year", "week", "count"
    )
    return staffing.unionByName(stuck)


@query("g9_lock_employee_hours")
def _(t):
    asked = _orders(t).select(
        "seq",
        "project",
        "start_date",
        F.date_add("start_date", 30).alias("end_date"),
        F.col("date").alias("commit_date"),
        F.lit(0).alias("creator"),
    )
    change = changes.lock_employee_hours(t, asked, dt.datetime(2024, 2, 1, 12))
    table = change.tables["timelock_events"].groupBy("employee", "commit_date", "creator").agg(F.count("*").alias("n"))
    return change.returned.withColumn("n", F.lit(None).cast("long")).unionByName(
        table.withColumn("seq", F.lit(None).cast("int"))
    )


@query("g10_timelock_view")
def _(t):
    return changes.latest_timelocks(t)


@query("g10_timelock_view_merged")
def _(t):
    """The view kept over three batches of events, of which the second brings some of the first again."""
    parts = [t.timelock_events.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)]
    view = changes.latest_timelocks(t.replace(timelock_events=parts[0]))
    view = changes.merged_timelocks(view, parts[1].unionByName(parts[0].filter("creator = 0")))
    return changes.merged_timelocks(view, parts[2])


TODAY = dt.date(2001, 11, 5)


def _invoice_requests(t: Tables) -> DataFrame:
    """Some without minutes, which are rejected."""
    return _orders(t).withColumn("minutes", F.when(F.col("seq") % 89 != 0, F.col("minutes")))


OUTCOME = (
    "part string, seq int, project string, date date, id string, amount double, minutes int, status string, type string,"
    " created date"
)


def _outcome(**parts: DataFrame) -> DataFrame:
    """Parts with some of the columns of OUTCOME, one after the other."""
    columns = [c.strip().split(" ") for c in OUTCOME.split(",")]
    result = None
    for name, rows in parts.items():
        rows = rows.withColumn("part", F.lit(name))
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns])
        result = rows if result is None else result.unionByName(rows)
    return result


@query("g11_upsert_invoice_balance")
def _(t):
    change = changes.upsert_invoice_balance(t, _invoice_requests(t), TODAY)
    return _outcome(invoices=change.tables["invoice_balance"], returned=change.returned, rejected=change.rejected)


@query("g12_upsert_invoice_status")
def _(t):
    asked = _orders(t).withColumn("status", F.when(F.col("seq") % 89 != 0, F.col("status")))
    change = changes.upsert_invoice_status(t, asked, TODAY)
    return _outcome(invoices=change.tables["invoice_balance"], returned=change.returned, rejected=change.rejected)


def _by_invoice(change: changes.Change, table: str, *columns: str) -> DataFrame:
    keys = change.tables["invoice_balance"].select(F.col("id").alias("invoice_balance"), "project", "date")
    return change.tables[table].join(keys, "invoice_balance").select("project", "date", "created", *columns)


@query("g13_upsert_expense")
def _(t):
    asked = _orders(t).withColumn("amount", F.when(F.col("seq") % 89 != 0, F.col("amount")))
    change = changes.upsert_expense(t, asked, TODAY)
    rows = _by_invoice(change, "expense", "type", "amount")
    return _outcome(expenses=rows, invoices=change.tables["invoice_balance"], returned=change.returned, rejected=change.rejected)


@query("g14_upsert_write_off")
def _(t):
    change = changes.upsert_write_off(t, _invoice_requests(t), TODAY)
    rows = _by_invoice(change, "write_off", "minutes")
    return _outcome(write_offs=rows, invoices=change.tables["invoice_balance"], returned=change.returned, rejected=change.rejected)


def _with_absence_in_staffing(t: Tables) -> Tables:
    """The tables before absence had one of its own: absence days are also staffed."""
    booked = t.time_entry.filter(codes.is_absence_reason(F.col("project"))).select(
        "employee", "project", "date", F.lit(60).alias("percentage")
    )
    return t.replace(staffing=t.staffing.unionByName(booked.distinct()))


@query("g15_move_absence_out_of_staffing")
def _(t):
    change = changes.move_absence_out_of_staffing(_with_absence_in_staffing(t))
    return _staffing_outcome(
        changes.Change(change.tables, change.returned.withColumn("seq", F.lit(None).cast("int")))
    )


@query("g16_first_absence_split")
def _(t):
    change = changes.move_absence_out_of_staffing(_with_absence_in_staffing(t), skip_holidays=True)
    return _staffing_outcome(
        changes.Change(change.tables, change.returned.withColumn("seq", F.lit(None).cast("int")))
    )


@query("g17_billable_flag_to_class")
def _(t):
    flag = F.when(F.col("billable") != "unavailable", F.col("billable") == "billable")
    flagged = t.projects.select("id", flag.alias("billable"))
    as_class = changes.billable_flag_to_class(flagged)
    back = changes.billable_class_to_flag(as_class).withColumnRenamed("billable", "flag")
    return as_class.join(back, "id")


@query("g18_rename_keys")
def _(t):
    gone = t.projects.filter(~F.col("active")).select(F.col("id").alias("old_id"))
    new_id = (
        F.when(F.col("old_id").endswith("3"), "X-3")  # given twice
        .when(F.col("old_id").rlike("^P.*5$"), F.concat(F.substring("old_id", 1, 8), F.lit("6")))  # there already
        .otherwise(F.concat(F.lit("X-"), "old_id"))
    )
    again = gone.filter(F.col("old_id").endswith("7")).withColumn("new_id", F.concat(F.lit("Y-"), "old_id"))
    change = changes.rename_keys(t, "projects", gone.withColumn("new_id", new_id).unionByName(again))
    parts = []
    for name, column in (("projects", "id"), ("time_entry", "project"), ("staffing", "project")):
        rows = change.tables[name].groupBy(F.col(column).alias("project")).agg(F.count("*").alias("n"))
        parts.append(rows.select(F.lit(name).alias("part"), "project", "n", F.lit(None).cast("string").alias("new_id")))
    for name, rows in (("returned", change.returned), ("rejected", change.rejected)):
        parts.append(rows.select(F.lit(name).alias("part"), F.col("old_id").alias("project"), F.lit(1).cast("long").alias("n"), "new_id"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("g19_write_authorisation_split")
def _(t):
    actor = F.lpad((F.col("minutes") % 7).cast("string"), 9, "0")
    edits = t.time_entry.select(
        "id", "employee", F.concat(F.lit("supplier#"), actor, F.lit("@example.org")).alias("email")
    )
    allowed, rejected = changes.split_by_write_access(t, edits)
    admin_allowed, _ = changes.split_by_write_access(t, edits, owner=None)
    parts = [("allowed", allowed), ("rejected", rejected), ("allowed to administrators", admin_allowed)]
    counted = [
        rows.groupBy("employee").agg(F.count("*").alias("n")).withColumn("outcome", F.lit(name)) for name, rows in parts
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("g20_table_contract_report")
def _(t):
    broken = t.replace(
        projects=t.projects.filter("active"),
        absence=t.time_entry.select(
            F.col("employee").alias("employee_id"), "date", F.col("project").alias("reason"), F.lit(100).alias("percentage")
        ),
    )
    return contracts.contract_report(contract_tables(broken))


@query("g21_emoji_domain_check")
def _(t):
    characters = t.documents.select(F.explode(F.split("text", "")).alias("value"))
    return (
        characters.groupBy("value")
        .agg(F.count("*").alias("n"))
        .select(F.ascii("value").alias("code_point"), "n", codes.is_emoji(F.col("value")).alias("is_emoji"))
        .groupBy("code_point", "is_emoji")
        .agg(F.sum("n").alias("n"))
    )
