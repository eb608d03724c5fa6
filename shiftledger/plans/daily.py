"""Facts folded to the day (whole company) or to the employee and day, before any period is looked at.

Every period report is a sum of daily rows, so each fact table is scanned and shuffled once however
many periods overlap. The first aggregation combines inside each task, which also takes the weight
out of a project, employee or date that holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.functions.codes import (
    BILLABLE,
    BONUS_PROJECTS,
    NONBILLABLE,
    PROFESSIONAL_DEVELOPMENT,
    SELF_REPORTED_SICK,
    UNAVAILABLE,
    is_absence_reason,
)
from shiftledger.plans.periods import Periods
from shiftledger.sources.tables import Tables


def project_classes(t: Tables) -> DataFrame:
    """The project columns that facts are looked up for. No broadcast hint: Spark broadcasts it while
    it is below the session's size threshold, and otherwise joins sorted with skewed keys split."""
    return t.projects.select(F.col("id").alias("project"), "billable", "deductable", "customer")


def unavailable_reasons(t: Tables) -> DataFrame:
    """Absence codes whose project is of class unavailable: nine rows at most, so always broadcast.
    The constant extra code is not billable, never unavailable, and plays no part here."""
    codes = t.projects.filter(is_absence_reason(F.col("id")) & (F.col("billable") == UNAVAILABLE))
    return F.broadcast(codes.select(F.col("id").alias("reason")))


def employment(t: Tables) -> DataFrame:
    return t.employees.select(F.col("id").alias("employee"), "date_of_employment", "termination_date")


def within_employment(date: Column, from_known: bool = False) -> Column:
    """Is a date inside the employment interval. An open end always holds; an unknown start holds
    too unless ``from_known``."""
    started = F.col("date_of_employment") <= date
    if not from_known:
        started = F.col("date_of_employment").isNull() | started
    return started & (F.col("termination_date").isNull() | (F.col("termination_date") >= date))


def minutes_of(condition: Column) -> Column:
    return F.when(condition, F.col("minutes"))


def one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


# Company level, one row per day


def entry_days(t: Tables, periods: Periods) -> DataFrame:
    """Time entries per day: minutes and row counts per project class and for single codes."""
    is_class = {name: F.col("billable") == name for name in (BILLABLE, NONBILLABLE, UNAVAILABLE)}
    if "entry_rollup" in t:

        def entries_if(condition: Column) -> Column:
            return F.sum(F.when(condition, F.col("entries")).otherwise(0))

        return (
            periods.restrict(t.entry_rollup)
            .groupBy("date")
            .agg(
                F.sum(minutes_of(is_class[BILLABLE])).alias("billable_minutes"),
                F.sum(minutes_of(is_class[UNAVAILABLE])).alias("unavailable_minutes"),
                F.sum("deductable_minutes").alias("deductable_minutes"),
                F.sum("sick_minutes").alias("sick_minutes"),
                F.sum("development_minutes").alias("development_minutes"),
                entries_if(F.col("billable").isNotNull()).alias("entries"),
                entries_if(is_class[BILLABLE]).alias("billable_entries"),
                entries_if(is_class[NONBILLABLE]).alias("nonbillable_entries"),
                entries_if(is_class[UNAVAILABLE]).alias("unavailable_entries"),
            )
        )
    rows = periods.restrict(t.time_entry).select("project", "date", "minutes")
    return (
        rows.join(project_classes(t), "project", "left")
        .groupBy("date")
        .agg(
            F.sum(minutes_of(is_class[BILLABLE])).alias("billable_minutes"),
            F.sum(minutes_of(is_class[UNAVAILABLE])).alias("unavailable_minutes"),
            F.sum(minutes_of(F.col("deductable"))).alias("deductable_minutes"),
            F.sum(minutes_of(F.col("project") == SELF_REPORTED_SICK)).alias("sick_minutes"),
            F.sum(minutes_of(F.col("project") == PROFESSIONAL_DEVELOPMENT)).alias("development_minutes"),
            F.count("billable").alias("entries"),
            F.sum(one_if(is_class[BILLABLE])).alias("billable_entries"),
            F.sum(one_if(is_class[NONBILLABLE])).alias("nonbillable_entries"),
            F.sum(one_if(is_class[UNAVAILABLE])).alias("unavailable_entries"),
        )
    )


def staffing_days(t: Tables, periods: Periods) -> DataFrame:
    """Staffing per day: row counts per class and the staffed percentage of billable projects."""
    is_class = {name: F.col("billable") == name for name in (BILLABLE, NONBILLABLE, UNAVAILABLE)}
    return (
        periods.restrict(t.staffing)
        .select("project", "date", "percentage")
        .join(project_classes(t), "project")
        .groupBy("date")
        .agg(
            F.count("*").alias("staffings"),
            F.sum(one_if(is_class[BILLABLE])).alias("billable_staffings"),
            F.sum(one_if(is_class[NONBILLABLE])).alias("nonbillable_staffings"),
            F.sum(one_if(is_class[UNAVAILABLE])).alias("unavailable_staffings"),
            F.sum(F.when(is_class[BILLABLE], F.col("percentage"))).alias("billable_percentage"),
        )
    )


def unavailable_staffing(t: Tables, periods: Periods) -> DataFrame:
    """(employee, date) of staffing on unavailable projects inside the employment interval."""
    projects = project_classes(t).filter(F.col("billable") == UNAVAILABLE).select("project")
    return (
        periods.restrict(t.staffing)
        .join(projects, "project", "left_semi")
        .select("employee", "date")
        .join(employment(t), "employee")
        .filter(within_employment(F.col("date")))
        .select("employee", "date")
    )


def unavailable_absence(t: Tables, periods: Periods) -> DataFrame:
    """(employee, date) of absence for an unavailable reason."""
    return (
        periods.restrict(t.absence)
        .join(unavailable_reasons(t), "reason", "left_semi")
        .select(F.col("employee_id").alias("employee"), "date")
    )


def employed_unavailable_absence(t: Tables, periods: Periods) -> DataFrame:
    """The same, kept only inside the employment interval."""
    return (
        unavailable_absence(t, periods)
        .join(employment(t), "employee")
        .filter(within_employment(F.col("date")))
        .select("employee", "date")
    )


def per_day(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("date").agg(F.count("*").alias(name))


def headcount_days(t: Tables, periods: Periods) -> DataFrame:
    """Employees per day of the span, as running sum of starts and ends: no employee is ever expanded
    to the days of their employment.

    ``headcount`` counts an unknown start as always employed, ``known_headcount`` leaves it out. The
    two ``_workdays`` columns hold the head count on working days and 0 on the others.
    """
    periods = periods.bounded()
    first, last = F.lit(periods.first), F.lit(max(periods.first, periods.last))
    staff = t.employees.select("date_of_employment", "termination_date").filter(
        F.coalesce(F.col("termination_date") >= F.col("date_of_employment"), F.lit(True))
    )
    known = one_if(F.col("date_of_employment").isNotNull())
    starts = staff.select(
        F.greatest(F.col("date_of_employment"), first).alias("date"), F.lit(1).alias("step"), known.alias("known")
    )
    ends = staff.filter(F.col("termination_date").isNotNull()).select(
        F.greatest(F.date_add("termination_date", 1), first).alias("date"),
        F.lit(-1).alias("step"),
        (-known).alias("known"),
    )
    steps = (
        starts.unionByName(ends)
        .filter(F.col("date") <= last)
        .groupBy("date")
        .agg(F.sum("step").alias("step"), F.sum("known").alias("known"))
    )
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on_workday = F.col("workdays").cast("long")
    return (
        periods.calendar(t.holidays)
        .join(steps, "date", "left")
        .withColumn("headcount", F.coalesce(F.sum("step").over(running), F.lit(0)))
        .withColumn("known_headcount", F.coalesce(F.sum("known").over(running), F.lit(0)))
        .select(
            "date",
            "workdays",
            "headcount",
            (F.col("headcount") * on_workday).alias("employee_workdays"),
            (F.col("known_headcount") * on_workday).alias("known_employee_workdays"),
        )
    )


def blocked_days(t: Tables, periods: Periods) -> DataFrame:
    """(employee, date) pairs that planning makes impossible: all staffing of the day is on
    unavailable projects, or there is an absence for an unavailable reason."""
    staffing = (
        periods.restrict(t.staffing)
        .join(project_classes(t), "project", "left")
        .select(
            "employee",
            "date",
            F.lit(1).alias("staffed"),
            one_if(F.col("billable") != UNAVAILABLE).alias("open"),
            F.lit(0).alias("absent"),
        )
    )
    absence = unavailable_absence(t, periods).select(
        "employee", "date", F.lit(0).alias("staffed"), F.lit(0).alias("open"), F.lit(1).alias("absent")
    )
    return (
        staffing.unionByName(absence)
        .groupBy("employee", "date")
        .agg(F.max("staffed").alias("staffed"), F.max("open").alias("open"), F.max("absent").alias("absent"))
        .filter((F.col("absent") == 1) | ((F.col("staffed") == 1) & (F.col("open") == 0)))
        .select("employee", "date")
    )


def possible_days(t: Tables, periods: Periods) -> DataFrame:
    """Head counts per day, plus the number of employees for whom it is a possible working day."""
    blocked = (
        blocked_days(t, periods)
        .join(employment(t), "employee")
        .filter(within_employment(F.col("date"), from_known=True))
        .groupBy("date")
        .agg(F.count("*").alias("blocked"))
    )
    possible = F.col("known_employee_workdays") - F.col("workdays") * F.coalesce("blocked", F.lit(0))
    counts = headcount_days(t, periods).join(blocked, "date", "left")
    return counts.withColumn("possible_workdays", possible).drop("blocked")


# Employee level


def class_minutes(t: Tables, periods: Periods) -> DataFrame:
    """Minutes per period, employee and project class: one scan for all three classes."""
    if "entry_rollup" in t:
        rolled = periods.restrict(t.entry_rollup).filter(F.col("billable").isNotNull())
        return periods.sum_by(rolled, "employee", "billable", minutes=F.col("minutes"))
    rows = periods.restrict(t.time_entry).join(project_classes(t).select("project", "billable"), "project")
    return periods.sum_by(rows, "employee", "billable", minutes=F.col("minutes"))


MEASURES = (
    "billable_minutes",
    "nonbillable_minutes",
    "unavailable_minutes",
    "bonus_minutes",
    "staffed_billable",
    "staffed_nonbillable",
    "absence_days",
)


def employee_period_facts(t: Tables, periods: Periods, planned: bool = True) -> DataFrame:
    """Per period and employee: minutes per class, staffed percentages, unavailable absence days and
    the number of working days with an entry.

    Entries, staffing and absence are stacked, so no chain of outer joins is needed. Different days are
    counted by one bit per day of the period, which combines inside each task like a sum; for long,
    overlapping or very many periods rows are folded to (employee, date) first. ``planned=False`` leaves staffing
    and absence out.
    """
    is_class = {name: F.col("billable") == name for name in (BILLABLE, NONBILLABLE, UNAVAILABLE)}
    classes = project_classes(t).select("project", "billable")

    def stacked(rows: DataFrame, employee: str, **measures: Column) -> DataFrame:
        empty = F.lit(None).cast("long")
        columns = [measures.get(m, empty).cast("long").alias(m) for m in (*MEASURES, "entered")]
        return rows.select(F.col(employee).alias("employee"), "date", *columns)

    if "entry_rollup" in t:
        entries, bonus = periods.restrict(t.entry_rollup), F.col("bonus_minutes")
    else:
        entries = periods.restrict(t.time_entry).join(classes, "project", "left")
        bonus = minutes_of(F.col("project").isin(*BONUS_PROJECTS) & F.col("billable").isNotNull())
    facts = stacked(
        entries,
        "employee",
        billable_minutes=minutes_of(is_class[BILLABLE]),
        nonbillable_minutes=minutes_of(is_class[NONBILLABLE]),
        unavailable_minutes=minutes_of(is_class[UNAVAILABLE]),
        bonus_minutes=bonus,
        entered=F.lit(1),
    )
    if planned:
        facts = facts.unionByName(
            stacked(
                periods.restrict(t.staffing).join(classes, "project"),
                "employee",
                staffed_billable=F.when(is_class[BILLABLE], F.col("percentage")),
                staffed_nonbillable=F.when(is_class[NONBILLABLE], F.col("percentage")),
            )
        ).unionByName(
            stacked(
                periods.restrict(t.absence)
                .withColumnRenamed("reason", "project")
                .join(classes.filter(is_class[UNAVAILABLE]), "project", "left_semi"),
                "employee_id",
                absence_days=F.lit(1),
            )
        )
    sums = [F.sum(m).alias(m) for m in MEASURES]
    days = periods.days(t.holidays)
    if periods.overlapping or periods.many_days or periods.longest > 63:
        folded = facts.groupBy("employee", "date").agg(*sums, F.max("entered").alias("entered"))
        entered_workdays = F.sum(F.when(F.col("workdays") == 1, F.col("entered")))
    else:
        folded = facts
        day_bit = F.expr("shiftleft(1L, datediff(date, from_date))")
        entered_workdays = F.bit_count(F.bit_or(F.when((F.col("workdays") == 1) & (F.col("entered") == 1), day_bit)))
    return (
        folded.join(days, "date")
        .groupBy("from_date", "to_date", "employee")
        .agg(*sums, entered_workdays.alias("entered_workdays"))
    )


def employee_periods(t: Tables, periods: Periods) -> DataFrame:
    """One row per employee and period that the employment touches: exactly the report rows."""
    return periods.attach_overlapping(t.employees, F.col("date_of_employment"), F.col("termination_date"))


def with_available_days(rows: DataFrame, t: Tables, periods: Periods) -> DataFrame:
    """Add workdays_employed: working days of the period cut to the employment interval."""
    start = F.greatest(F.col("date_of_employment"), F.col("from_date"))
    end = F.least(F.col("termination_date"), F.col("to_date"))
    return periods.with_workdays(rows, t.holidays, start, end, "workdays_employed")
