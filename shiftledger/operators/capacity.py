"""Staffing, absence and capacity: what is planned, and what could be."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.codes import BILLABLE, HOURS_PER_DAY, NONBILLABLE, UNAVAILABLE
from shiftledger.functions.dates import days_between, is_weekday, iso_week_label, iso_week_monday, week_start
from shiftledger.functions.ratios import ratio
from shiftledger.operators.calendar import week_dates, without_holidays
from shiftledger.operators.dimensions import employees_in_periods, number_of_employees_in_periods
from shiftledger.plans.daily import (
    blocked_days,
    employed_unavailable_absence,
    employment,
    entry_days,
    headcount_days,
    per_day,
    possible_days,
    project_classes,
    staffing_days,
    unavailable_absence,
    unavailable_staffing,
    within_employment,
)
from shiftledger.plans.periods import Periods
from shiftledger.sources.tables import Tables

PERIOD = ("from_date", "to_date")


# Planned hours and days per employee


def staffed_hours_for_employees(t: Tables, periods: Periods, billable: str) -> DataFrame:
    """Staffed hours (7.5 at 100 percent) per employee and period on projects of one class."""
    projects = project_classes(t).filter(F.col("billable") == billable).select("project")
    staffed = periods.restrict(t.staffing).join(projects, "project", "left_semi")
    return periods.sum_by(staffed, "employee", percentage=F.col("percentage")).select(
        *PERIOD, F.col("employee").alias("id"), (F.col("percentage") * F.lit(HOURS_PER_DAY) / F.lit(100.0)).alias("hours")
    )


def staffed_billable_hours_for_employees(t: Tables, periods: Periods) -> DataFrame:
    return staffed_hours_for_employees(t, periods, BILLABLE)


def staffed_nonbillable_hours_for_employees(t: Tables, periods: Periods) -> DataFrame:
    return staffed_hours_for_employees(t, periods, NONBILLABLE)


def unavailable_absence_days_for_employees(t: Tables, periods: Periods) -> DataFrame:
    """Absence rows per employee and period whose reason is an unavailable project."""
    projects = project_classes(t).filter(F.col("billable") == UNAVAILABLE).select(F.col("project").alias("reason"))
    absent = periods.restrict(t.absence).join(projects, "reason", "left_semi")
    return periods.sum_by(absent, "employee_id", days=F.lit(1)).select(
        *PERIOD, F.col("employee_id").alias("id"), "days"
    )


def staffed_hours(t: Tables) -> DataFrame:
    """Staffed hours per employee and day, cut where staffing and absence exceed 100 percent together.
    Staffing on holidays does not count; a day with only absence has 0."""
    staffing = without_holidays(t.staffing, t.holidays).select(
        "employee", "date", F.coalesce("percentage", F.lit(0)).alias("staffed"), F.lit(None).cast("int").alias("absent")
    )
    absence = t.absence.select(
        F.col("employee_id").alias("employee"),
        "date",
        F.lit(None).cast("int").alias("staffed"),
        F.coalesce("percentage", F.lit(0)).alias("absent"),
    )
    both = (
        staffing.unionByName(absence)
        .groupBy("employee", "date")
        .agg(F.sum("staffed").alias("staffed"), F.sum("absent").alias("absent"))
    )
    over = F.greatest(F.col("staffed") + F.col("absent") - 100, F.lit(0))
    return both.select(
        "employee",
        "date",
        F.coalesce((F.col("staffed") - over) * F.lit(0.375), F.lit(0.0)).alias("total_staffed_hours"),
    )


def available_dates(t: Tables, requests: DataFrame) -> DataFrame:
    """Working days of the week in each (employee, year, week) request on which the employee has neither
    staffing nor absence. Other columns of a request are kept."""
    free = without_holidays(week_dates(requests).filter(is_weekday(F.col("date"))), t.holidays)
    asked = free.select("employee", F.trunc("date", "week").alias("_week")).distinct()
    taken = (
        t.staffing.select("employee", "date")
        .unionByName(t.absence.select(F.col("employee_id").alias("employee"), "date"))
        .withColumn("_week", F.trunc("date", "week"))
        .join(asked, ["employee", "_week"], "left_semi")
        .select("employee", "date")
    )
    return free.join(taken, ["employee", "date"], "left_anti").withColumnRenamed("date", "available_date")


def employee_worked_days_per_week(
    t: Tables, start: dt.date, weeks: int = 8, employee: int | None = None
) -> DataFrame:
    """Staffing rows in seven-day buckets from ``start``, with the sorted list of projects, repeats included;
    of one employee or of all."""
    if weeks < 1:
        raise ValueError(f"weeks has to be greater than 0, but was {weeks}")
    bucket = F.floor(F.datediff("date", F.lit(start)) / 7).cast("int")
    staffed = t.staffing.filter(
        F.col("date").between(F.lit(start), F.lit(start + dt.timedelta(days=7 * weeks - 1)))
    ).withColumn("start_of_week", F.date_add(F.lit(start), bucket * 7))
    if employee is not None:
        staffed = staffed.filter(F.col("employee") == employee)
    # Counted per project before gathering: the gathered group has one row per project.
    counted = staffed.groupBy("employee", "start_of_week", "project").agg(F.count("*").cast("int").alias("n"))
    gathered = F.array_sort(F.collect_list(F.struct("project", "n")))
    repeated = F.flatten(F.transform(gathered, lambda p: F.array_repeat(p["project"], p["n"])))
    return counted.groupBy("employee", "start_of_week").agg(
        repeated.alias("projects"), F.sum("n").cast("int").alias("days")
    )


def worked_days_per_week(t: Tables, start: dt.date, weeks: int = 8) -> DataFrame:
    """The weekly buckets of all known employees."""
    known = t.employees.select(F.col("id").alias("employee"))
    weekly = employee_worked_days_per_week(t, start, weeks).join(known, "employee", "left_semi")
    return weekly.select("employee", "projects", "start_of_week", "days")


def default_start_of_week(today: dt.date) -> dt.date:
    """Monday of this week; on a Sunday, the next day."""
    return today + dt.timedelta(days=1 - today.isoweekday() % 7)


def _whole_weeks(start: dt.date, end: dt.date) -> tuple[Column, Column]:
    monday = start - dt.timedelta(days=start.weekday())
    sunday = end + dt.timedelta(days=6 - end.weekday())
    return F.lit(monday), F.lit(sunday)


def weekly_staffing_dates(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Staffing per employee, calendar year, ISO week and project: the sorted days of the month and their
    number. The range is widened to whole weeks."""
    staff = t.employees.select(
        F.col("id").alias("employee_id"), "first_name", "last_name", "date_of_employment", "termination_date"
    )
    return (
        t.staffing.filter(F.col("date").between(*_whole_weeks(start, end)))
        .groupBy(
            F.col("employee").alias("employee_id"),
            F.year("date").alias("year"),
            F.weekofyear("date").alias("week"),
            F.col("project").alias("project_id"),
        )
        .agg(F.array_sort(F.collect_list(F.dayofmonth("date"))).alias("days"), F.count("*").alias("n_days"))
        .join(staff, "employee_id", "left")
        .select(
            "employee_id",
            "first_name",
            "last_name",
            "date_of_employment",
            "termination_date",
            "year",
            "week",
            "days",
            "project_id",
            "n_days",
        )
    )


def weekly_staffing(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Planned days of employed people, one row per employee, project and ISO week, with the map from date
    to percentage (absence counts as 100) and the employee's availability in that week. An employee
    with nothing planned has one row without project."""
    bounds = _whole_weeks(start, end)
    planned = (
        t.staffing.filter(F.col("date").between(*bounds))
        .select("employee", "project", "date", "percentage", F.lit(0).alias("rank"))
        .unionByName(
            t.absence.filter(F.col("date").between(*bounds)).select(
                F.col("employee_id").alias("employee"), F.col("reason").alias("project"), "date",
                F.lit(100).alias("percentage"), F.lit(1).alias("rank"),
            )
        )
        # A date planned as staffing and as absence of the same code has one entry in the map; absence wins.
        .groupBy("employee", "project", "date")
        .agg(F.max(F.struct("rank", "percentage"))["percentage"].alias("percentage"))
    )
    weeks = (
        planned.groupBy("employee", "project", week_start(F.col("date")).alias("from_date"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("date", "percentage")))).alias("dates"))
        .withColumn("to_date", F.date_add("from_date", 6))
    )
    spine = Periods.weeks(t.spark, start, end, whole=True)
    projects = t.projects.select(F.col("id").alias("project"), F.col("name").alias("project_name"), "billable")
    rows = (
        _with_possible_percentage(weeks, t, spine)
        .join(_employee_availability(t, spine), ["employee", *PERIOD], "left")
        .join(projects, "project", "left")
        .select(
            F.col("employee").alias("planned_employee"),
            "project",
            "project_name",
            "billable",
            "from_date",
            iso_week_label(F.col("from_date")).alias("week"),
            "dates",
            _percentage(F.col("possible"), F.coalesce("unavailable", F.lit(0))).alias("availability"),
        )
    )
    staff = employees_in_periods(t, Periods.single(t.spark, start, end)).select(
        "employee_id", "first_name", "last_name", "role", "image_url"
    )
    return staff.join(rows, F.col("employee_id") == F.col("planned_employee"), "left").drop("planned_employee")


def weekly_staffing_json(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """One JSON document per employee and planned project, with an object per ISO week; ``sub_row`` is NULL
    for an employee with nothing planned. Documents are not merged into one for the whole company,
    which would have to pass through a single task; the array is a matter of the reader."""
    by_text = F.transform_keys("dates", lambda date, _: date.cast("string")).alias("dates")
    week_data = F.map_from_entries(
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("project").isNotNull(), F.struct("week", F.struct(by_text, "availability").alias("data"))
                )
            ),
            lambda a, b: F.when(a["week"] < b["week"], -1).when(a["week"] > b["week"], 1).otherwise(0),
        )
    )
    keys = ("employee_id", "first_name", "last_name", "role", "image_url", "project", "project_name", "billable")
    grouped = weekly_staffing(t, start, end).groupBy(*keys).agg(week_data.alias("weeks"))
    fixed = F.to_json(
        F.create_map(
            F.lit("name"), "project", F.lit("billable"), "billable", F.lit("project_name"), "project_name"
        )
    )
    merged = F.concat(F.expr("left(_fixed, length(_fixed) - 1)"), F.lit(","), F.expr("substring(_weeks, 2)"))
    return (
        grouped.withColumn("_fixed", fixed)
        .withColumn("_weeks", F.to_json("weeks"))
        .select(
            F.col("employee_id").alias("id"),
            F.concat_ws(" ", "first_name", "last_name").alias("name"),
            "role",
            F.col("image_url").alias("imageUrl"),
            "project",
            F.when(F.col("project").isNotNull(), merged).alias("sub_row"),
        )
    )


def weekly_staffing_document(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """One JSON document per employee: id, name, role, imageUrl and subRows, an array with an object per planned
    project (in order of its code), which holds an object per ISO week; an empty array if nothing is planned.

    Weeks are nested in projects and projects in employees by one aggregation each, and the last ends per employee, so
    that no task ever holds the whole company.
    """
    employee = ("id", "name", "role", "imageUrl")
    rows = weekly_staffing_json(t, start, end)
    sub_rows = F.array_sort(
        F.collect_list(F.when(F.col("project").isNotNull(), F.struct("project", "sub_row"))),
        lambda a, b: F.when(a["project"] < b["project"], -1).when(a["project"] > b["project"], 1).otherwise(0),
    )
    head = F.to_json(F.struct(*employee), {"ignoreNullFields": "false"})
    nested = rows.groupBy(*employee).agg(F.transform(sub_rows, lambda r: r["sub_row"]).alias("_sub_rows"))
    document = F.concat(
        F.expr("left(_head, length(_head) - 1)"), F.lit(',"subRows":['), F.concat_ws(",", "_sub_rows"), F.lit("]}")
    )
    return nested.withColumn("_head", head).select("id", document.alias("document"))


# Availability


def _percentage(possible: Column, unavailable: Column) -> Column:
    """Available share in percent, not below 0, two decimals; 0 when nothing is possible."""
    share = F.round(
        F.try_divide(((possible - unavailable) * 100).cast("decimal(20,0)"), possible.cast("decimal(20,0)")), 2
    )
    return F.when(possible == 0, F.lit(0)).otherwise(F.greatest(share, F.lit(0))).cast("decimal(5,2)")


def _with_possible_percentage(rows: DataFrame, t: Tables, periods: Periods) -> DataFrame:
    """Add 100 percent for each working day of the row's period."""
    counted = periods.with_workdays(rows, t.holidays, F.col("from_date"), F.col("to_date"), "_workdays")
    return counted.withColumn("possible", F.col("_workdays") * 100).drop("_workdays")


def _employee_availability(t: Tables, periods: Periods) -> DataFrame:
    return periods.sum_by(unavailable_absence(t, periods), "employee", unavailable=F.lit(100))


def employee_availability_percentage(t: Tables, periods: Periods) -> DataFrame:
    """Per employee and period: working days without unavailable absence, in percent."""
    everyone = periods.attach(t.employees.select(F.col("id").alias("employee")))
    return (
        _with_possible_percentage(everyone, t, periods)
        .join(_employee_availability(t, periods), ["employee", *PERIOD], "left")
        .select(
            "employee",
            *PERIOD,
            _percentage(F.col("possible"), F.coalesce("unavailable", F.lit(0))).alias("availability"),
        )
    )


def availability_percentage(t: Tables, periods: Periods) -> DataFrame:
    """Per period, the same over all employees whose employment touches it."""
    active = number_of_employees_in_periods(t, periods, permanent_only=False)
    absent = (
        _employee_availability(t, periods)
        .join(employment(t), "employee")
        .filter(
            (F.col("date_of_employment") <= F.col("to_date"))
            & (F.col("termination_date").isNull() | (F.col("termination_date") >= F.col("from_date")))
        )
        .groupBy(*PERIOD)
        .agg(F.sum("unavailable").alias("unavailable"))
    )
    possible = F.col("possible") * F.col("employee_count")
    return (
        _with_possible_percentage(periods.df, t, periods)
        .join(active, list(PERIOD))
        .join(absent, list(PERIOD), "left")
        .select(*PERIOD, _percentage(possible, F.coalesce("unavailable", F.lit(0))).alias("availability"))
    )


def as_week_object(weekly: DataFrame, week: str, value: str) -> DataFrame:
    """One JSON object from ISO week label to value; NULL values kept. One row per week, so it is small."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(week), F.col(value))))
    return weekly.agg(F.to_json(F.map_from_entries(pairs)).alias("result"))


def weekly_availability(t: Tables, start: dt.date, end: dt.date, days: int = 8) -> DataFrame:
    """Company availability per ISO week, one decimal. Each window is eight days: it reaches into the next
    Monday."""
    return availability_percentage(t, Periods.weeks(t.spark, start, end, days=days, whole=True)).select(
        iso_week_label(F.col("from_date")).alias("week"), F.round("availability", 1).alias("availability")
    )


def weekly_availability_json(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    return as_week_object(weekly_availability(t, start, end), "week", "availability")


def weekly_forecasted_fg(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Forecast billing ratio per ISO week, truncated toward zero."""
    weeks = Periods.weeks(t.spark, start, end, whole=True)
    return forecasted_fg(t, weeks, safe).select(
        iso_week_label(F.col("from_date")).alias("week"), F.col("percent").cast("long").alias("percent")
    )


def weekly_forecasted_fg_json(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    return as_week_object(weekly_forecasted_fg(t, start, end, safe), "week", "percent")


def weekly_fg(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Planned billing ratio per ISO week from percentages: staffed billable hours by possible hours of the
    active employees less unavailable absence; one decimal, 0 when nothing is available."""
    weeks = Periods.weeks(t.spark, start, end, whole=True)
    facts = weeks.calendar(t.holidays).select("date", "workdays")
    facts = facts.join(staffing_days(t, weeks).select("date", "billable_percentage"), "date", "left")
    facts = facts.join(per_day(unavailable_absence(t, weeks), "absences"), "date", "left")
    totals = weeks.total(facts, "workdays", "billable_percentage", "absences").join(
        number_of_employees_in_periods(t, weeks, permanent_only=False), list(PERIOD)
    )
    billable = F.coalesce(F.col("billable_percentage") * F.lit(HOURS_PER_DAY) / F.lit(100.0), F.lit(0.0))
    available = (F.col("employee_count") * F.col("workdays") - F.coalesce("absences", F.lit(0))) * F.lit(HOURS_PER_DAY)
    ratio = F.when(available > 0, F.try_divide(billable, available) * 100).otherwise(0.0)
    return totals.select(iso_week_label(F.col("from_date")).alias("week"), F.round(ratio, 1).alias("fg"))


def weekly_fg_json(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    return as_week_object(weekly_fg(t, start, end), "week", "fg")


# Company capacity per period


def unavailable_staffing_hours(t: Tables, periods: Periods) -> DataFrame:
    """7.5 hours for each staffing row on an unavailable project; the percentage is ignored."""
    return periods.total(staffing_days(t, periods), "unavailable_staffings").select(
        *PERIOD,
        (F.coalesce("unavailable_staffings", F.lit(0)) * F.lit(HOURS_PER_DAY)).alias("unavailable_hours"),
    )


def planned_billable_hours(t: Tables, periods: Periods) -> DataFrame:
    """7.5 hours for each billable staffing row; the percentage is ignored."""
    return periods.total(staffing_days(t, periods), "billable_staffings").select(
        *PERIOD, (F.coalesce("billable_staffings", F.lit(0)) * F.lit(HOURS_PER_DAY)).alias("billable_hours")
    )


def _forecast_days(t: Tables, periods: Periods) -> DataFrame:
    """Day-level parts of the forecast, one row per day of the calendar."""
    return (
        headcount_days(t, periods)
        .select("date", "employee_workdays")
        .join(per_day(unavailable_staffing(t, periods), "staffed_away"), "date", "left")
        .join(per_day(employed_unavailable_absence(t, periods), "absent"), "date", "left")
    )


def _forecast_hours(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) * F.lit(HOURS_PER_DAY)


def forecasted_available_hours(t: Tables, periods: Periods) -> DataFrame:
    """Working hours of all employees less unavailable staffing and absence, all cut to employment."""
    totals = periods.total(_forecast_days(t, periods), "employee_workdays", "staffed_away", "absent")
    everything, staffing, absence = (_forecast_hours(n) for n in ("employee_workdays", "staffed_away", "absent"))
    return totals.select(
        *PERIOD,
        everything.alias("all_hours"),
        staffing.alias("unavail_staffing_hours"),
        absence.alias("unavail_absence_hours"),
        (everything - staffing - absence).alias("available_hours"),
    )


def forecasted_fg(t: Tables, periods: Periods, safe: bool = False) -> DataFrame:
    """Planned billable hours by forecast available hours, in percent."""
    daily = _forecast_days(t, periods).join(
        staffing_days(t, periods).select("date", "billable_staffings"), "date", "left"
    )
    totals = periods.total(daily, "employee_workdays", "staffed_away", "absent", "billable_staffings")
    planned = _forecast_hours("billable_staffings")
    available = (
        _forecast_hours("employee_workdays") - _forecast_hours("staffed_away") - _forecast_hours("absent")
    )
    return totals.select(
        *PERIOD,
        planned.alias("planned_billable_hours"),
        available.alias("available_hours"),
        (ratio(planned, available, safe) * 100).alias("percent"),
    )


def unavailable_staffing_dates(t: Tables, periods: Periods) -> DataFrame:
    """(employee, date) of unavailable staffing inside each period and the employment interval."""
    return (
        unavailable_staffing(t, periods)
        .join(periods.days(), "date")
        .select(*PERIOD, F.col("employee").alias("employee_id"), F.col("date").alias("work_day"))
    )


def all_absence_dates(t: Tables, periods: Periods) -> DataFrame:
    """(employee, date) of unavailable absence inside each period and the employment interval."""
    return (
        employed_unavailable_absence(t, periods)
        .join(periods.days(), "date")
        .select(*PERIOD, F.col("employee").alias("employee_id"), F.col("date").alias("absence_date"))
    )


def _employee_workdays(t: Tables, periods: Periods) -> DataFrame:
    """Working days of each employee in each period, cut to employment. Each employee row makes its own
    days, so nothing is shuffled to build them."""
    rows = periods.attach(employment(t))
    start = F.greatest("date_of_employment", "from_date")
    end = F.least("termination_date", "to_date")
    days = rows.select(
        *PERIOD, "employee", "date_of_employment", F.explode(days_between(start, end)).alias("date")
    ).filter(is_weekday(F.col("date")))
    return without_holidays(days, t.holidays)


def all_employee_work_dates(t: Tables, periods: Periods) -> DataFrame:
    return _employee_workdays(t, periods).select(
        *PERIOD, F.col("employee").alias("employee_id"), F.col("date").alias("work_date")
    )


def is_possible_work_day(t: Tables, pairs: DataFrame) -> DataFrame:
    """For (employee, date) pairs: a working day, employed, not planned only on unavailable projects and not
    absent for an unavailable reason. An unknown employee is never possible."""
    asked = pairs.select("employee", "date").distinct()
    free = without_holidays(asked.filter(is_weekday(F.col("date"))), t.holidays)
    employed = (
        free.join(employment(t), "employee")
        .filter(within_employment(F.col("date"), from_known=True))
        .select("employee", "date")
    )
    # facts are cut to the pairs asked for before they are folded
    staffing = t.staffing.join(employed, ["employee", "date"], "left_semi")
    pairs_of = employed.select(F.col("employee").alias("employee_id"), "date")
    absence = t.absence.join(pairs_of, ["employee_id", "date"], "left_semi")
    blocked = blocked_days(t.replace(staffing=staffing, absence=absence), Periods(employed))
    possible = employed.join(blocked, ["employee", "date"], "left_anti")
    return asked.join(possible.withColumn("_ok", F.lit(True)), ["employee", "date"], "left").select(
        "employee", "date", F.coalesce("_ok", F.lit(False)).alias("is_possible")
    )


def possible_work_dates_per_employee(t: Tables, periods: Periods) -> DataFrame:
    """All possible working days of all employees in each period."""
    days = _employee_workdays(t, periods).filter(F.col("date_of_employment").isNotNull())
    return days.join(blocked_days(t, periods), ["employee", "date"], "left_anti").select(
        *PERIOD, F.col("employee").alias("employee_id"), F.col("date").alias("work_day")
    )


STAFFING_CLASSES = (BILLABLE, NONBILLABLE, UNAVAILABLE)
STAFFING_MEASURES = ("possible_workdays", *(f"{c}_staffings" for c in STAFFING_CLASSES))


def _staffing_hours() -> list[Column]:
    """Hours over totals of STAFFING_MEASURES."""
    return [
        (F.coalesce("possible_workdays", F.lit(0)) * F.lit(HOURS_PER_DAY)).alias("available_hours"),
        *[(F.col(f"{c}_staffings") * F.lit(HOURS_PER_DAY)).alias(f"{c}_hours") for c in STAFFING_CLASSES],
    ]


def accumulated_staffing_hours(t: Tables, periods: Periods) -> DataFrame:
    """Possible working hours, and 7.5 hours per staffing row by class (NULL without any staffing)."""
    daily = possible_days(t, periods).join(staffing_days(t, periods), "date", "left")
    return periods.total(daily, *STAFFING_MEASURES).select(*PERIOD, *_staffing_hours())


def _named_monday(day: dt.date) -> dt.date:
    """Monday of the ISO week that the day's calendar year and week number name together."""
    january = dt.date(day.year, 1, 4)
    return january - dt.timedelta(days=january.weekday()) + dt.timedelta(weeks=day.isocalendar().week - 1)


def staffing_and_billing_overview(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Per week reached by stepping from ``start``: planned against actual hours and billing ratio.

    Weeks are named by calendar year and ISO week number, and their dates follow from that name, so
    around New Year a row can describe another week than the step fell in. Weeks without billed hours
    are left out.
    """
    steps = t.spark.range(max((end - start).days // 7 + 1, 0)).select(
        F.date_add(F.lit(start), (F.col("id") * 7).cast("int")).alias("step")
    )
    named = steps.select(F.year("step").alias("year"), F.weekofyear("step").alias("week"))
    monday = iso_week_monday(F.col("year"), F.col("week"))
    weeks = named.withColumn("from_date", monday).withColumn("to_date", F.date_add(monday, 6))
    mondays = [_named_monday(start + dt.timedelta(days=n)) for n in range(0, (end - start).days + 1, 7)]
    if not mondays:
        mondays = [start]
    periods = Periods.from_table(weeks, first=min(mondays), last=max(mondays) + dt.timedelta(days=6))
    periods.rows = len(mondays)
    daily = possible_days(t, periods).join(staffing_days(t, periods), "date", "left")
    daily = daily.join(entry_days(t, periods), "date", "left")
    totals = periods.total(daily, *STAFFING_MEASURES, *BILLED_MEASURES).filter(F.col("billable_entries") > 0)
    hours = totals.select(*PERIOD, *_staffing_hours(), *billed_hours())
    available, billable = F.col("available_hours"), F.col("billable_hours")
    actual_available, actual_billable = F.col("sum_available_hours"), F.col("sum_billable_hours")
    return (
        weeks.join(hours, list(PERIOD))
        .select(
            "year",
            "week",
            *PERIOD,
            available.alias("available_hours"),
            billable.alias("billable_hours"),
            (ratio(billable, available, safe) * 100).alias("planned_fg"),
            actual_available.alias("actual_available_hours"),
            actual_billable.alias("actual_billable_hours"),
            (ratio(actual_billable, actual_available, safe) * 100).alias("actual_fg"),
            (actual_available - available).alias("deviation_available_hours"),
            (actual_billable - billable).alias("deviation_billable_hours"),
            (ratio(actual_billable - billable, available, safe) * 100).alias("deviation_fg"),
        )
    )


# Billed hours, the base of the billing ratio


def sum_business_hours(t: Tables, periods: Periods) -> DataFrame:
    """Business hours of all employees per period, each cut to the employment interval.

    The sum over employees of working days equals the sum over working days of the head count.
    """
    return periods.total(headcount_days(t, periods), "employee_workdays").select(
        *PERIOD, (F.coalesce("employee_workdays", F.lit(0)) * F.lit(HOURS_PER_DAY)).alias("sum_business_hours")
    )


BILLED_MEASURES = ("employee_workdays", "unavailable_minutes", "billable_minutes", "billable_entries")


def billed_days(t: Tables, periods: Periods) -> DataFrame:
    """Head counts and time entries per day."""
    return headcount_days(t, periods).join(entry_days(t, periods), "date", "left")


def billed_hours() -> list[Column]:
    """Hours over totals of BILLED_MEASURES; only meant for periods with billable entries."""
    business = F.col("employee_workdays") * F.lit(HOURS_PER_DAY)
    return [
        (business - F.col("unavailable_minutes") / F.lit(60.0)).alias("sum_available_hours"),
        (F.col("billable_minutes") / F.lit(60.0)).alias("sum_billable_hours"),
    ]


def accumulated_billed_hours(t: Tables, periods: Periods) -> DataFrame:
    """Available hours (business less unavailable) and billed hours per period. A period without billable
    entries has no row; available hours are NULL when nothing unavailable was entered."""
    totals = periods.total(billed_days(t, periods), *BILLED_MEASURES)
    return totals.filter(F.col("billable_entries") > 0).select(*PERIOD, *billed_hours())
