"""Time-entry aggregations: hours per employee, project and period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.functions.codes import BILLABLE, HOURS_PER_DAY, NONBILLABLE, UNAVAILABLE
from shiftledger.functions.dates import days_between, overlaps
from shiftledger.operators.calendar import business_hours
from shiftledger.plans.daily import (
    class_minutes,
    employee_period_facts,
    employee_periods,
    entry_days,
    with_available_days,
)
from shiftledger.plans.periods import Periods
from shiftledger.sources.tables import Tables

PERIOD = ("from_date", "to_date")
MAX_SPAN_DAYS = 366


def hours(minutes: str | Column) -> Column:
    column = F.col(minutes) if isinstance(minutes, str) else minutes
    return column / F.lit(60.0)


def hours_or_zero(minutes: str) -> Column:
    return F.coalesce(F.col(minutes) / F.lit(60.0), F.lit(0.0))


# One employee at a time


def accumulated_hours(t: Tables, periods: Periods) -> DataFrame:
    """Hours per employee in each period, 0 if none."""
    sums = periods.sum_by(periods.restrict(t.time_entry), "employee", minutes=F.col("minutes"))
    everyone = periods.attach(t.employees.select(F.col("id").alias("employee")))
    return everyone.join(sums, ["employee", *PERIOD], "left").select(
        "employee", *PERIOD, hours_or_zero("minutes").alias("hours")
    )


def accumulated_overtime(
    t: Tables, requests: DataFrame, reject: bool = False, last: dt.date | None = None
) -> DataFrame:
    """Overtime since employment for (employee, end_date) requests: hours entered, minus business hours,
    minus overtime already paid out.

    An end date after the employee's termination is an error; with ``reject`` such rows are kept,
    marked and without a value. Unknown employment date gives NULL. ``last`` is a known bound of the
    end dates and prunes the scan.
    """
    bounded = (lambda df, c: df.filter(F.col(c) <= F.lit(last))) if last is not None else (lambda df, c: df)
    staff = t.employees.select(F.col("id").alias("employee"), "date_of_employment", "termination_date")
    asked = requests.select("employee", "end_date").distinct().join(staff, "employee")

    def up_to_end(rows: DataFrame, name: str) -> DataFrame:
        """Minutes up to each end date: a running sum over the days and end dates of an employee."""
        marks = asked.select(
            "employee", F.col("end_date").alias("date"), F.lit(None).cast("int").alias("minutes"), F.lit(True).alias("_asked")
        )
        days = rows.select("employee", "date", "minutes", F.lit(None).cast("boolean").alias("_asked")).unionByName(marks)
        days = days.groupBy("employee", "date").agg(F.sum("minutes").alias("minutes"), F.max("_asked").alias("_asked"))
        so_far = Window.partitionBy("employee").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        summed = days.withColumn(name, F.sum("minutes").over(so_far)).filter("_asked")
        return summed.select("employee", F.col("date").alias("end_date"), name)

    hired = asked.select("employee", "date_of_employment").distinct()
    entered = bounded(t.time_entry, "date").select("employee", "date", "minutes").join(hired, "employee")
    worked = up_to_end(entered.filter(F.col("date") >= F.col("date_of_employment")), "worked_minutes")
    paid_out = bounded(t.paid_overtime, "paid_date").filter(F.col("paid_date").isNotNull())
    paid_out = paid_out.select("employee", F.col("paid_date").alias("date"), "minutes").join(hired, "employee", "left_semi")
    paid = up_to_end(paid_out, "paid_minutes")
    planned = business_hours(asked, F.col("date_of_employment"), F.col("end_date"), t.holidays)
    late = F.coalesce(F.col("end_date") > F.col("termination_date"), F.lit(False))
    overtime = hours_or_zero("worked_minutes") - F.col("business_hours") - hours_or_zero("paid_minutes")
    rows = planned.join(worked, ["employee", "end_date"], "left").join(paid, ["employee", "end_date"], "left")
    if reject:
        return rows.select(
            "employee", "end_date", F.when(~late, overtime).alias("overtime"), late.alias("after_termination")
        )
    failed = F.raise_error(F.lit("end date after employee termination date")).cast("double")
    return rows.select("employee", "end_date", F.when(late, failed).otherwise(overtime).alias("overtime"))


def entries_with_project(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Hours per employee, day and project; a day without entries gives one row without project.

    ``for_employee`` is the employee asked for, ``employee`` is NULL on an empty day.
    """
    sums = (
        t.time_entry.filter(F.col("date").between(F.lit(start), F.lit(end)))
        .groupBy("employee", "date", "project")
        .agg(F.sum("minutes").alias("minutes"))
    )
    spine = t.employees.select(
        F.col("id").alias("for_employee"), F.explode(days_between(F.lit(start), F.lit(end))).alias("work_date")
    )
    same = (F.col("for_employee") == F.col("employee")) & (F.col("work_date") == F.col("date"))
    return spine.join(sums, same, "left").select(
        "for_employee", "work_date", "employee", "project", hours("minutes").alias("hours")
    )


def entries_sums(t: Tables, start: dt.date, days: int = 7) -> DataFrame:
    """Minutes per employee and date in the half-open range of ``days`` days from ``start``."""
    return (
        t.time_entry.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(start + dt.timedelta(days=days))))
        .groupBy("employee", "date")
        .agg(F.sum("minutes").alias("sum"))
    )


def hours_per_employee(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Per employee the array of (date, hours) over every day of the range, hours rounded to one decimal
    and NULL on days without entries. At most 366 days between the bounds."""
    if (end - start).days > MAX_SPAN_DAYS:
        raise ValueError(f"maximum time span allowed is {MAX_SPAN_DAYS} days")
    rounded = F.round(F.col("minutes").cast("decimal(20,0)") / F.lit(60).cast("decimal(2,0)"), 1).cast("double")
    by_day = (
        t.time_entry.filter(F.col("date").between(F.lit(start), F.lit(end)))
        .groupBy("employee", "date")
        .agg(F.sum("minutes").alias("minutes"))
        .groupBy("employee")
        .agg(F.map_from_entries(F.collect_list(F.struct("date", rounded.alias("hours")))).alias("by_day"))
    )
    name = F.concat("first_name", F.lit(" "), "last_name")
    series = F.transform(
        days_between(F.lit(start), F.lit(end)),
        lambda day: F.struct(day.alias("date"), F.try_element_at("by_day", day).alias("hours")),
    )
    return t.employees.join(by_day, F.col("id") == F.col("employee"), "left").select(
        "id", name.alias("name"), series.alias("hours")
    )


def hours_per_employee_json(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """The same with the series as a JSON array of one-key objects, NULL hours kept."""
    pairs = F.transform("hours", lambda x: F.create_map(x["date"].cast("string"), x["hours"]))
    return hours_per_employee(t, start, end).select("name", F.to_json(pairs).alias("hours"))


def unregistered_days(t: Tables, periods: Periods) -> DataFrame:
    """Per employee and period, working days without any entry; not cut to the employment interval."""
    entered = employee_period_facts(t, periods, planned=False).select("employee", *PERIOD, "entered_workdays")
    everyone = periods.attach(t.employees.select(F.col("id").alias("employee")))
    rows = periods.with_workdays(everyone, t.holidays, F.col("from_date"), F.col("to_date"), "workdays")
    left_over = F.col("workdays") - F.coalesce("entered_workdays", F.lit(0))
    return rows.join(entered, ["employee", *PERIOD], "left").select(
        "employee", *PERIOD, left_over.cast("int").alias("unregistered_days")
    )


# Per project and class


def accumulated_entries_on_project(t: Tables, periods: Periods) -> DataFrame:
    """Whole hours (truncated) per project and period."""
    projects = t.projects.select(F.col("id").alias("project"), "billable", "name")
    sums = periods.sum_by(periods.restrict(t.time_entry), "project", minutes=F.col("minutes"))
    return sums.join(projects, "project").select(
        *PERIOD, F.expr("minutes div 60").alias("hours"), "project", "billable", "name"
    )


def class_minutes_for_employees(t: Tables, periods: Periods, billable: str) -> DataFrame:
    """Minutes per employee and period on projects of one class; no row without an entry."""
    return class_minutes(t, periods).filter(F.col("billable") == billable).select(
        *PERIOD, F.col("employee").alias("id"), F.col("minutes").alias("sum")
    )


def unavailable_hours_for_employees(t: Tables, periods: Periods) -> DataFrame:
    return class_minutes_for_employees(t, periods, UNAVAILABLE)


def billable_hours_for_employees(t: Tables, periods: Periods) -> DataFrame:
    return class_minutes_for_employees(t, periods, BILLABLE)


def nonbillable_hours_for_employees(t: Tables, periods: Periods) -> DataFrame:
    return class_minutes_for_employees(t, periods, NONBILLABLE)


def time_distribution(t: Tables, periods: Periods) -> DataFrame:
    """Number of entries per class times 7.5 (rows, not minutes); NULL when a period has none."""
    counts = ("entries", "billable_entries", "nonbillable_entries", "unavailable_entries")
    total = periods.total(entry_days(t, periods), *counts)
    any_entry = F.col("entries") > 0
    return total.select(
        *PERIOD,
        *[
            F.when(any_entry, F.col(f"{name}_entries") * F.lit(HOURS_PER_DAY)).alias(f"{name}_hours")
            for name in (BILLABLE, NONBILLABLE, UNAVAILABLE)
        ],
    )


def total_hours_on_project(t: Tables, periods: Periods, project: str) -> DataFrame:
    """Hours on one project code per period, NULL if none."""
    daily = (
        periods.restrict(t.time_entry)
        .filter(F.col("project") == project)
        .groupBy("date")
        .agg(F.sum("minutes").alias("minutes"))
    )
    return periods.total(daily, "minutes").select(*PERIOD, hours("minutes").alias("project_hours"))


def sick_hours(t: Tables, periods: Periods) -> DataFrame:
    """Self-reported sick hours per period, NULL if none."""
    return periods.total(entry_days(t, periods), "sick_minutes").select(
        *PERIOD, hours("sick_minutes").alias("sick_hours")
    )


def unavailable_time_entry_hours(t: Tables, periods: Periods) -> DataFrame:
    """Hours on unavailable projects per period, NULL if none."""
    return periods.total(entry_days(t, periods), "unavailable_minutes").select(
        *PERIOD, hours("unavailable_minutes").alias("unavailable_hours")
    )


def product_development_hours(t: Tables, periods: Periods) -> DataFrame:
    """Hours on deductable projects per period, 0 if none."""
    return periods.total(entry_days(t, periods), "deductable_minutes").select(
        *PERIOD, hours_or_zero("deductable_minutes").alias("hours")
    )


# Status per employee


def _last_entries(t: Tables) -> DataFrame:
    """Last entry date and last creation date per employee, over all time. A missing creation time
    sorts last of all, so it wins."""
    if "entry_rollup" in t:
        return t.entry_rollup.groupBy("employee").agg(
            F.max("date").alias("last_date"),
            F.when(F.sum("entries") == F.sum("timed"), F.max("last_created")).cast("date").alias("last_created"),
        )
    return t.time_entry.groupBy("employee").agg(
        F.max("date").alias("last_date"),
        F.when(F.count("*") == F.count("created"), F.max("created")).cast("date").alias("last_created"),
    )


def _status(t: Tables, periods: Periods, planned: bool) -> DataFrame:
    facts = employee_period_facts(t, periods, planned)
    rows = employee_periods(t, periods).select(
        *PERIOD, "id", "first_name", "last_name", "email", "date_of_employment", "termination_date"
    )
    last = _last_entries(t).withColumnRenamed("employee", "_last_of")
    rows = periods.with_workdays(rows, t.holidays, F.col("from_date"), F.col("to_date"), "workdays")
    return (
        with_available_days(rows, t, periods)
        .join(facts.withColumnRenamed("employee", "id"), ["id", *PERIOD], "left")
        .join(last, F.col("id") == F.col("_last_of"), "left")
    )


def _status_columns(planned: bool) -> list[Column]:
    columns = [
        F.concat("first_name", F.lit(" "), "last_name").alias("name"),
        F.col("email"),
        (F.col("workdays_employed") * F.lit(HOURS_PER_DAY) - hours_or_zero("unavailable_minutes")).alias(
            "available_hours"
        ),
    ]
    billable = hours_or_zero("billable_minutes").alias("billable_hours")
    nonbillable = hours_or_zero("nonbillable_minutes").alias("non_billable_hours")

    def staffed(name: str) -> Column:
        return F.coalesce(F.col(name) * F.lit(HOURS_PER_DAY) / F.lit(100.0), F.lit(0.0))

    if planned:
        columns += [
            staffed("staffed_billable").alias("staffed_billable_hours"),
            billable,
            staffed("staffed_nonbillable").alias("staffed_nonbillable_hours"),
            nonbillable,
            F.coalesce(F.col("absence_days") * F.lit(HOURS_PER_DAY), F.lit(0.0)).alias("unavailable_absence_hours"),
        ]
    else:
        columns += [billable, nonbillable]
    unregistered = F.col("workdays") - F.coalesce("entered_workdays", F.lit(0))
    return [
        *columns,
        hours_or_zero("unavailable_minutes").alias("unavailable_hours"),
        unregistered.cast("int").alias("unregistered_days"),
        F.col("last_date"),
        F.col("last_created"),
    ]


def time_tracking_status(t: Tables, periods: Periods) -> DataFrame:
    """Per period and employed employee: available, billable, other and unavailable hours, days without
    entries, and the last entry."""
    return _status(t, periods, planned=False).select(*PERIOD, "id", *_status_columns(False))


def time_tracking_status_with_staffing(t: Tables, periods: Periods) -> DataFrame:
    """The status plus staffed hours and planned unavailable absence."""
    return _status(t, periods, planned=True).select(*PERIOD, "id", *_status_columns(True))


def time_tracking_status_by_week(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """The full status for each week reached by stepping from ``start``."""
    weeks = Periods.weeks(t.spark, start, end)
    return _status(t, weeks, planned=True).select(F.col("from_date").alias("week_start"), "id", *_status_columns(True))


# Billing ratio and bonus per employee


def _employee_hours(t: Tables, periods: Periods) -> DataFrame:
    """Every employee in every period, employed or not."""
    facts = employee_period_facts(t, periods, planned=False).withColumnRenamed("employee", "id")
    rows = periods.attach(t.employees.select("id", "date_of_employment", "termination_date"))
    return with_available_days(rows, t, periods).join(facts, ["id", *PERIOD], "left")


def _available_hours() -> Column:
    return F.col("workdays_employed") * F.lit(HOURS_PER_DAY) - hours_or_zero("unavailable_minutes")


def fg_for_employees(t: Tables, periods: Periods) -> DataFrame:
    """Available and billable hours per employee and period."""
    return _employee_hours(t, periods).select(
        *PERIOD,
        F.col("id").alias("employee"),
        _available_hours().alias("available_hours"),
        hours_or_zero("billable_minutes").alias("billable_hours"),
    )


def bonus_hours_for_employees(t: Tables, periods: Periods) -> DataFrame:
    """The same with the bonus codes added to the billable hours, on top of their own class."""
    return _employee_hours(t, periods).select(
        *PERIOD,
        F.col("id").alias("employee"),
        _available_hours().alias("available_hours"),
        (hours_or_zero("billable_minutes") + hours_or_zero("bonus_minutes")).alias("bonus_billable_hours"),
    )


def employee_yearly_bonus(t: Tables, first_year: int, last_year: int | None = None) -> DataFrame:
    """Bonus of each employee per ISO year: for each week with available hours, by billing ratio and by
    whether a tenure role was held in that week."""
    weeks = Periods.iso_weeks(t.spark, first_year, last_year)
    first, last = F.lit(weeks.first), F.lit(weeks.last)
    held_from = F.trunc(F.greatest(F.col("from_date"), first), "week")
    held_to = F.trunc(F.least(F.coalesce("to_date", last), last), "week")
    held_weeks = F.when(held_from <= held_to, F.sequence(held_from, held_to, F.expr("interval 7 days")))
    held = (
        t.employee_tenure_role.filter(overlaps(F.col("from_date"), F.col("to_date"), first, last))
        .select(F.col("employee_id").alias("id"), F.explode(held_weeks).alias("from_date"))
        .distinct()
        .withColumn("tenured", F.lit(True))
    )
    billed = hours_or_zero("billable_minutes") + hours_or_zero("bonus_minutes")
    ratio = F.try_divide(billed, _available_hours())
    tenured = F.coalesce("tenured", F.lit(False))
    amount = (
        F.when(_available_hours() <= 0, 0)
        .when(ratio > 0.95, F.when(tenured, 1000).otherwise(750))
        .when(ratio > 0.90, F.when(tenured, 750).otherwise(500))
        .otherwise(0)
    )
    facts = employee_period_facts(t, weeks, planned=False).withColumnRenamed("employee", "id")
    earned = (
        with_available_days(employed_weeks(t.employees, weeks), t, weeks)
        .join(facts, ["id", *PERIOD], "left")
        .join(held, ["id", "from_date"], "left")
        .groupBy("id", F.extract(F.lit("YEAROFWEEK"), F.col("from_date")).alias("year"))
        .agg(F.sum(amount).alias("bonus"))
    )
    years = F.explode(F.sequence(F.lit(first_year), F.lit(first_year if last_year is None else last_year)))
    return (
        t.employees.select("id", years.alias("year"))
        .join(earned, ["id", "year"], "left")
        .select(F.col("id").alias("employee"), "year", F.coalesce("bonus", F.lit(0)).cast("int").alias("bonus"))
    )


def employed_weeks(employees: DataFrame, weeks: Periods) -> DataFrame:
    """One row per employee and ISO week of the span that the employment touches. Weeks follow from the interval of the
    employee, cut to the span; no employee meets a week outside of it."""
    first, last = F.lit(weeks.first), F.lit(weeks.last)
    start = F.trunc(F.greatest(F.col("date_of_employment"), first), "week")
    end = F.trunc(F.least(F.coalesce("termination_date", last), last), "week")
    known = F.col("date_of_employment").isNotNull() & (start <= end)
    mondays = F.when(known, F.sequence(start, end, F.expr("interval 7 days")))
    rows = employees.select("id", "date_of_employment", "termination_date", F.explode(mondays).alias("from_date"))
    return rows.withColumn("to_date", F.date_add("from_date", 6))


def employee_weekly_fg(t: Tables, first_year: int, last_year: int | None = None) -> DataFrame:
    """Available and billable hours of each employee for every ISO week of the years."""
    weeks = Periods.iso_weeks(t.spark, first_year, last_year)
    return _employee_hours(t, weeks).select(
        F.col("id").alias("employee"),
        F.col("iso_year").alias("year"),
        "week_number",
        F.col("from_date").alias("week_start"),
        _available_hours().alias("available_hours"),
        hours_or_zero("billable_minutes").alias("billable_hours"),
    )


# Periodic report

# Report lines and the codes they cover.
PROJECT_LABELS = {
    "FAG1000": "Fagutvikling",
    "ADM1003": "Åremålsadmin",
    "PER1000": "Perm med lønn",
    "REK1000": "Rekruttering",
    "SYK1001": "Sykemelding",
    "SYK1002": "Sykt barn",
    "SYK1003": "SYK1003",
}
INTERNAL_PREFIX, INTERNAL_LABEL = "INT", "Internsystemer"
ALWAYS_SHOWN = {
    "Sykdom (inkl barn)": ("SYK1000", "SYK1002"),
    "Foreldreperm": ("PER1002", "PER1003", "PER1004"),
    "Ferie": ("FER1000",),
}
BILLABLE_LABEL, AVAILABLE_LABEL = "Fakturerbart", "Totalt tilgjengelig"
ADMIN_ROLE = "Annet"
BY_ADMIN = {"Admin og Salg ført av admin/ledelse": ("ADM1000", "SAL1000")}
BY_OTHERS = {"Salg ført av andre": ("SAL1000",), "Admin ført av andre": ("ADM1000",)}


def periodic_report(t: Tables, periods: Periods) -> DataFrame:
    """Report lines per period: hours (two decimals) of relabelled internal projects, which only show
    when there are entries, then fixed lines that always show, with NULL when empty.

    One scan of the entries serves all lines of minutes: they are folded to (period, project, kind
    of role) and each such row is then sent to the lines it belongs to. The two company totals come
    from the status report. An employee without a role counts for neither role line.
    """
    project, role = F.col("project"), F.col("role")
    by_role = (*BY_ADMIN.values(), *BY_OTHERS.values())
    role_codes = sorted({code for codes in by_role for code in codes})
    fixed_codes = sorted({*PROJECT_LABELS, *role_codes, *(c for codes in ALWAYS_SHOWN.values() for c in codes)})
    relevant = periods.restrict(t.time_entry).filter(
        project.isin(*fixed_codes) | project.startswith(INTERNAL_PREFIX)
    )
    roles = t.employees.select(F.col("id").alias("employee"), (role == ADMIN_ROLE).alias("admin"))
    entered = relevant.select("employee", "project", "date", "minutes").join(roles, "employee", "left")
    folded = periods.sum_by(entered, "project", "admin", minutes=F.col("minutes"))

    def line(label: str, condition: Column) -> Column:
        return F.when(condition, F.lit(label))

    lines = [line(label, project == code) for code, label in PROJECT_LABELS.items()]
    lines.append(line(INTERNAL_LABEL, project.startswith(INTERNAL_PREFIX)))
    lines += [line(label, project.isin(*codes)) for label, codes in ALWAYS_SHOWN.items()]
    lines += [line(label, project.isin(*codes) & F.col("admin")) for label, codes in BY_ADMIN.items()]
    lines += [line(label, project.isin(*codes) & ~F.col("admin")) for label, codes in BY_OTHERS.items()]
    summed = (
        folded.withColumn("prosjekt", F.explode(F.array_compact(F.array(*lines))))
        .groupBy(*PERIOD, "prosjekt")
        .agg(F.sum("minutes").alias("minutes"))
    )
    always = [*ALWAYS_SHOWN, *BY_ADMIN, *BY_OTHERS]
    rounded = F.round(F.col("minutes").cast("decimal(20,0)") / F.lit(60).cast("decimal(2,0)"), 2).cast("double")
    on_demand = summed.filter(~F.col("prosjekt").isin(*always)).select(*PERIOD, "prosjekt", rounded.alias("timer"))
    shown = periods.df.select(*PERIOD, F.explode(F.array(*map(F.lit, always))).alias("prosjekt"))
    fixed = shown.join(summed, [*PERIOD, "prosjekt"], "left").select(*PERIOD, "prosjekt", rounded.alias("timer"))

    totals = (
        _status(t, periods, planned=False)
        .groupBy(*PERIOD)
        .agg(
            F.sum(F.coalesce("billable_minutes", F.lit(0))).alias("billable"),
            F.sum(F.coalesce("unavailable_minutes", F.lit(0))).alias("unavailable"),
            F.sum("workdays_employed").alias("workdays"),
        )
    )
    available = F.col("workdays") * F.lit(HOURS_PER_DAY) - hours("unavailable")
    company = (
        periods.df.select(*PERIOD)
        .join(totals, list(PERIOD), "left")
        .select(
            *PERIOD,
            F.inline(
                F.array(
                    F.struct(F.lit(BILLABLE_LABEL).alias("prosjekt"), hours("billable").alias("timer")),
                    F.struct(F.lit(AVAILABLE_LABEL).alias("prosjekt"), available.alias("timer")),
                )
            ),
        )
    )
    return on_demand.unionByName(fixed).unionByName(company)
