"""Dimension views and look-ups over tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.codes import (
    BILLABLE,
    SICK_CHILD,
    TIME_OFF_IN_LIEU,
    VACATION,
    is_absence_reason,
)
from shiftledger.plans.daily import employee_periods
from shiftledger.plans.periods import Periods
from shiftledger.sources.tables import Tables


def absence_reasons(t: Tables) -> DataFrame:
    """Projects that are absence codes, plus the constant time-off-in-lieu row. Nothing is de-duplicated."""
    id_, name, billable = TIME_OFF_IN_LIEU
    constant = t.spark.range(1).select(
        F.lit(id_).alias("id"), F.lit(name).alias("name"), F.lit(billable).alias("billable")
    )
    return t.projects.filter(is_absence_reason(F.col("id"))).select("id", "name", "billable").unionByName(constant)


def absence_spent(t: Tables) -> DataFrame:
    """Minutes per employee, date and absence code, where any were spent."""
    known = F.broadcast(absence_reasons(t).select(F.col("id").alias("project")))
    return (
        t.time_entry.filter(is_absence_reason(F.col("project")))
        .join(known, "project", "left_semi")
        .groupBy(F.col("employee").alias("employee_id"), "date", F.col("project").alias("reason"))
        .agg(F.sum("minutes").alias("minutes"))
        .filter(F.col("minutes") > 0)
    )


def available_projects(t: Tables) -> DataFrame:
    """Active projects that are not absence codes, with their customer nested."""
    customers = t.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    # Every id in the absence view passes the code predicate, so the anti join is a filter.
    return (
        t.projects.filter(F.col("active") & ~is_absence_reason(F.col("id")))
        .join(customers, F.col("customer") == F.col("customer_id"), "left")
        .select(
            "id",
            "name",
            "billable",
            "active",
            F.struct(F.col("customer_id").alias("id"), F.col("customer_name").alias("name")).alias("customer"),
        )
    )


def employees_roles(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """Employee row as a struct with the sorted array of its roles, empty if it has none.

    ``asked`` is a table of ids (column ``id``) or e-mails (column ``email``) that narrows the answer.
    """
    staff = t.employees
    if asked is not None:
        staff = staff.join(asked, asked.columns, "left_semi").select(*t.employees.columns)
    # Equal roles are counted before they are gathered, so the gathered group has one row per role.
    counted = t.employee_role.groupBy("employee_id", "role_type").agg(F.count("*").cast("int").alias("n"))
    repeated = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("role_type", "n"))),
            lambda r: F.array_repeat(r["role_type"], r["n"]),
        )
    )
    roles = counted.filter(F.col("role_type").isNotNull()).groupBy("employee_id").agg(repeated.alias("roles"))
    return staff.join(roles, F.col("id") == F.col("employee_id"), "left").select(
        F.struct(*[staff[c] for c in staff.columns]).alias("employee"),
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
    )


def employees_in_periods(t: Tables, periods: Periods) -> DataFrame:
    """Employees whose employment touches each period."""
    return employee_periods(t, periods).select(
        "from_date", "to_date", F.col("id").alias("employee_id"), "first_name", "last_name", "role", "image_url"
    )


def number_of_employees_in_periods(t: Tables, periods: Periods, permanent_only: bool = True) -> DataFrame:
    """Number of employees touching each period, by default only those in permanent positions.

    Employees are folded to distinct employment intervals before they meet the periods.
    """
    staff = t.employees.filter("has_permanent_position") if permanent_only else t.employees
    intervals = staff.groupBy("date_of_employment", "termination_date").agg(F.count("*").alias("n"))
    touching = periods.attach_overlapping(intervals, F.col("date_of_employment"), F.col("termination_date"))
    counts = touching.groupBy("from_date", "to_date").agg(F.sum("n").alias("employee_count"))
    return periods.df.join(counts, ["from_date", "to_date"], "left").select(
        "from_date", "to_date", F.coalesce("employee_count", F.lit(0)).alias("employee_count")
    )


def projects_by_day(time_entry: DataFrame) -> DataFrame:
    """(employee, worked): on which days an employee entered time, as a bit per day.

    ``worked`` has one (project, year, days) per project and year, where ``days`` holds a number per month whose bit n
    stands for day n + 1. Rows combine inside each task by ``bit_or``, so of any number of entries one row per employee,
    project and year is shuffled, and a year takes twelve numbers. (``bitmap_construct_agg`` would keep four kilobytes.)
    """
    bit = F.expr("shiftleft(1, day(date) - 1)")
    by_month = [F.bit_or(F.when(F.month("date") == m, bit)) for m in range(1, 13)]
    months = [F.coalesce(column, F.lit(0)) for column in by_month]
    years = time_entry.groupBy("employee", "project", F.year("date").alias("year")).agg(F.array(*months).alias("days"))
    return years.groupBy("employee").agg(F.collect_list(F.struct("project", "year", "days")).alias("worked"))


def _worked_in(worked: Column, start: Column, end: Column) -> Column:
    """Is one of the days of a (project, year, days) inside a closed range, whose bounds may be NULL for none."""
    month = F.sequence(F.lit(1), F.lit(12))
    number = worked["year"] * 12

    def asked(days: Column, at: Column) -> Column:
        here = number + at + 1
        first = F.coalesce(F.year(start) * 12 + F.month(start), F.lit(-(1 << 30)))
        last = F.coalesce(F.year(end) * 12 + F.month(end), F.lit(1 << 30))
        # of the first month the days from its first on, of the last one those up to its last
        low = F.when(here == first, F.call_function("shiftleft", F.lit(-1), F.day(start) - 1)).otherwise(F.lit(-1))
        high = F.when(here == last, F.call_function("shiftright", F.lit((1 << 31) - 1), 31 - F.day(end))).otherwise(F.lit(-1))
        return F.when((here >= first) & (here <= last), days.bitwiseAND(low).bitwiseAND(high)).otherwise(0)

    masked = F.transform(month, lambda m: asked(F.element_at(worked["days"], m), m - 1))
    return F.exists(masked, lambda days: days != 0)


def projects_info_for_employee_in_range(
    t: Tables, requests: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """For (employee, date_range) requests, the projects the employee entered time on in that range.

    ``date_range`` is text such as ``[1998-01-01,1998-02-01)``: a square bracket includes its bound,
    an empty bound is infinite, ``empty`` holds no date, and a NULL argument gives no rows. ``first`` and ``last`` are
    known bounds of all ranges and prune the scan.

    A request looks up one row, the employee's days by project as bits, and only the projects it meets leave that row.
    """
    form = r"^\s*([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])\s*$"
    text = F.col("date_range")

    def bound(group: int):
        value = F.regexp_extract(text, form, group)
        return F.when(~F.lower(value).isin("", "infinity", "-infinity"), value.cast("date"))

    parsed = (
        requests.dropna(subset=["employee", "date_range"])
        .select("employee", "date_range")
        .distinct()
        .filter(F.lower(F.trim(text)) != "empty")
        .filter(text.rlike(form) | F.raise_error(F.concat(F.lit("malformed range: "), text)).cast("boolean"))
        .withColumn(
            "_from", F.when(F.regexp_extract(text, form, 1) == "[", bound(2)).otherwise(F.date_add(bound(2), 1))
        )
        .withColumn("_to", F.when(F.regexp_extract(text, form, 4) == "]", bound(3)).otherwise(F.date_sub(bound(3), 1)))
    )
    entered = t.time_entry.select("employee", "project", "date").dropna()
    if first is not None:
        entered = entered.filter(F.col("date") >= F.lit(first))
    if last is not None:
        entered = entered.filter(F.col("date") <= F.lit(last))
    met = F.filter("worked", lambda w: _worked_in(w, F.col("_from"), F.col("_to")))
    found = F.array_distinct(F.transform(met, lambda w: w["project"]))
    hits = (
        parsed.join(projects_by_day(entered), "employee")
        .select("employee", "date_range", F.explode(found).alias("project"))
    )
    projects = t.projects.select(F.col("id").alias("project"), "name", "active", "customer")
    customers = t.customers.select(F.col("id").alias("customer"), F.col("name").alias("customer_name"))
    return (
        hits.join(projects, "project")
        .join(customers, "customer")
        .select(
            "employee",
            "date_range",
            F.col("project").alias("id"),
            "name",
            "active",
            F.col("customer").alias("customer_id"),
            "customer_name",
        )
    )


def employees_on_projects(t: Tables, periods: Periods) -> DataFrame:
    """Employees with billable staffing per customer, strictly between the bounds of each period."""
    billable = t.projects.filter(F.col("billable") == BILLABLE).select(F.col("id").alias("project"), "customer")
    staffed = (
        periods.restrict(t.staffing)
        .select("employee", "project", "date")
        .join(billable, "project")
        .select("employee", "customer", "date")
        .join(periods.days(), "date")
        .filter((F.col("date") > F.col("from_date")) & (F.col("date") < F.col("to_date")))
        .select("from_date", "to_date", "employee", "customer")
        .distinct()
    )
    customers = t.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    staff = t.employees.select("id", "first_name", "last_name", "emoji")
    return (
        staffed.join(customers, F.col("customer") == F.col("customer_id"))
        .join(staff, F.col("employee") == F.col("id"))
        .select("from_date", "to_date", "customer_id", "customer_name", "first_name", "last_name", "id", "emoji")
    )


def employee_project_responsible(
    t: Tables,
    as_of: dt.date | dt.datetime,
    days_back: int = 22,
    days_ahead: int = 21,
    exclude: tuple[str, ...] = (VACATION,),
) -> DataFrame:
    """The responsible of each employee's most staffed active project around ``as_of``.

    Equal totals go to the smallest project id. The earlier rule is ``days_back=15, days_ahead=14,
    exclude=()``.
    """
    moment = as_of if isinstance(as_of, dt.datetime) else dt.datetime.combine(as_of, dt.time())
    after, before = moment - dt.timedelta(days=days_back), moment + dt.timedelta(days=days_ahead)
    last = before.date() if before.time() > dt.time() else before.date() - dt.timedelta(days=1)
    active = t.projects.filter("active").select(F.col("id").alias("project"), "responsible")
    near = t.staffing.filter((F.col("date") > F.lit(after.date())) & (F.col("date") <= F.lit(last)))
    if exclude:
        near = near.filter(~F.col("project").isin(*exclude))
    totals = near.groupBy("employee", "project").agg(F.count("*").alias("total"))
    most = (
        totals.join(active, "project")
        .groupBy("employee")
        .agg(F.min(F.struct((-F.col("total")).alias("rank"), "project", "responsible")).alias("most"))
    )
    return most.select("employee", F.col("most.responsible").alias("project_responsible"))


def employee_has_sick_child_days(t: Tables) -> DataFrame:
    """Per employee, whether any time was ever entered for a sick child."""
    sick = t.time_entry.filter(F.col("project") == SICK_CHILD).select(F.col("employee").alias("id")).distinct()
    return t.employees.select("id").join(sick.withColumn("_sick", F.lit(True)), "id", "left").select(
        F.col("id").alias("employee"), F.coalesce("_sick", F.lit(False)).alias("has_sick_child_days")
    )


def projects_for_employee_dates(t: Tables, periods: Periods) -> DataFrame:
    """Per employee and day of the periods: projects staffed, worked on or absent for, with minutes and
    staffed percentage.

    An absence on a staffed code does not add to its percentage; a staffed code listed twice among
    the absence reasons counts twice. Sources are stacked and folded once, so that no outer join has
    to move all unmatched rows through one NULL key.
    """
    reasons = F.broadcast(absence_reasons(t).select(F.col("id").alias("reason")))
    none_int = F.lit(None).cast("long")
    staffed = periods.restrict(t.staffing).select(
        "employee",
        "date",
        "project",
        F.col("percentage").cast("long").alias("staffed"),
        none_int.alias("minutes"),
        F.lit(0).alias("entered"),
        none_int.alias("absent"),
        F.lit(0).alias("absences"),
    )
    entered = periods.restrict(t.time_entry).select(
        "employee",
        "date",
        "project",
        none_int.alias("staffed"),
        F.col("minutes").cast("long").alias("minutes"),
        F.lit(1).alias("entered"),
        none_int.alias("absent"),
        F.lit(0).alias("absences"),
    )
    absent = (
        periods.restrict(t.absence)
        .join(reasons, "reason")
        .select(
            F.col("employee_id").alias("employee"),
            "date",
            F.col("reason").alias("project"),
            none_int.alias("staffed"),
            none_int.alias("minutes"),
            F.lit(0).alias("entered"),
            F.col("percentage").cast("long").alias("absent"),
            F.lit(1).alias("absences"),
        )
    )
    folded = (
        staffed.unionByName(entered)
        .unionByName(absent)
        .groupBy("employee", "date", "project")
        .agg(
            F.sum("staffed").alias("staffed"),
            F.sum("minutes").alias("minutes"),
            F.max("entered").alias("entered"),
            F.sum("absent").alias("absent"),
            F.sum("absences").alias("absences"),
        )
    )
    projects = t.projects.select(F.col("id").alias("project"), "name", "customer")
    customers = t.customers.select(F.col("id").alias("customer"), F.col("name").alias("customer_name"))
    known = folded.join(projects, "project", "left").join(customers, "customer", "left")
    is_staffed = F.col("staffed").isNotNull() & F.col("customer_name").isNotNull()
    fan_out = F.greatest(F.col("absences"), F.lit(1))
    code, constant_name, _ = TIME_OFF_IN_LIEU
    absence_name = F.greatest(F.col("name"), F.when(F.col("project") == code, F.lit(constant_name)))
    worked_name = F.when(F.col("entered") == 1, F.col("name"))
    worked_customer = F.when(F.col("entered") == 1, F.col("customer_name"))
    internal = F.when(F.col("absences") > 0, F.lit("Internt"))
    wanted = periods.days().select("date").distinct()
    return (
        known.filter(is_staffed | (F.col("entered") == 1) | (F.col("absences") > 0))
        .join(wanted, "date", "left_semi")
        .select(
            "employee",
            "date",
            F.col("project").alias("id"),
            F.when(is_staffed, F.col("name"))
            .otherwise(F.greatest(worked_name, F.when(F.col("absences") > 0, absence_name)))
            .alias("project"),
            F.when(is_staffed, F.col("customer_name"))
            .otherwise(F.greatest(worked_customer, internal))
            .alias("customer"),
            (F.coalesce("minutes", F.lit(0)) * F.when(is_staffed, fan_out).otherwise(1)).cast("long").alias("minutes"),
            F.when(is_staffed, F.col("staffed") * fan_out)
            .otherwise(F.coalesce("absent", F.lit(0)))
            .cast("long")
            .alias("percentage_staffed"),
        )
    )
