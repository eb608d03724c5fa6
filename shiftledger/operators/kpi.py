"""KPIs over periods: billing ratio, sick leave, development, deviation, hourly price, project economics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.codes import BILLABLE, HOURS_PER_DAY, UNAVAILABLE
from shiftledger.functions.dates import iso_week_monday
from shiftledger.functions.ratios import ratio
from shiftledger.operators.capacity import BILLED_MEASURES, accumulated_billed_hours, billed_days, billed_hours
from shiftledger.operators.dimensions import number_of_employees_in_periods
from shiftledger.plans.daily import entry_days, headcount_days, project_classes, staffing_days, with_available_days
from shiftledger.plans.periods import Periods
from shiftledger.sources.tables import Tables

PERIOD = ("from_date", "to_date")


# Billing ratio


def fg(t: Tables, periods: Periods, safe: bool = False) -> DataFrame:
    """Billed by available hours in percent; no row for a period without billed hours."""
    billed = ratio(F.col("sum_billable_hours"), F.col("sum_available_hours"), safe) * 100
    return accumulated_billed_hours(t, periods).select(*PERIOD, billed.alias("fg"))


def kpi_fg(t: Tables, start: dt.date, end: dt.date, months: int = 6, safe: bool = False) -> DataFrame:
    return fg(t, Periods.month_windows(t.spark, start, end, months), safe)


def kpi_accumulated_fg(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    return fg(t, Periods.year_to_date(t.spark, start, end), safe).toDF("sum_start_date", "sum_end_date", "summed_fg")


# Other ratios of hours


def kpi_product_development(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Hours on deductable projects per six-month window."""
    windows = Periods.month_windows(t.spark, start, end)
    minutes = F.coalesce("deductable_minutes", F.lit(0))
    return windows.total(entry_days(t, windows), "deductable_minutes").select(
        *PERIOD, (minutes / F.lit(60.0)).alias("payload")
    )


def kpi_sick(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Self-reported sick hours by business hours per six-month window."""
    windows = Periods.month_windows(t.spark, start, end)
    daily = headcount_days(t, windows).join(entry_days(t, windows).select("date", "sick_minutes"), "date", "left")
    business = F.col("employee_workdays") * F.lit(HOURS_PER_DAY)
    return windows.total(daily, "employee_workdays", "sick_minutes").select(
        *PERIOD, ratio(F.col("sick_minutes") / F.lit(60.0), business, safe).alias("payload")
    )


def kpi_prodev(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Professional development hours by available hours, in percent, per six-month window."""
    windows = Periods.month_windows(t.spark, start, end)
    totals = windows.total(billed_days(t, windows), *BILLED_MEASURES, "development_minutes")
    hours, available = F.col("development_minutes") / F.lit(60.0), F.col("sum_available_hours")
    return (
        totals.filter(F.col("billable_entries") > 0)
        .select(*PERIOD, "development_minutes", *billed_hours())
        .select(
            *PERIOD,
            (ratio(hours, available, safe) * 100).alias("percent"),
            hours.alias("project_hours"),
            available.alias("available_hours"),
        )
    )


def kpi_fgdev(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Planned against billed hours over the twelve weeks before each monthly step, with the deviation in
    percent of the billed hours."""
    windows = Periods.trailing_weeks(t.spark, start, end)
    staffed = staffing_days(t, windows).select("date", "billable_staffings")
    daily = billed_days(t, windows).join(staffed, "date", "left")
    totals = windows.total(daily, *BILLED_MEASURES, "billable_staffings").filter(F.col("billable_entries") > 0)
    planned = F.coalesce("billable_staffings", F.lit(0)) * F.lit(HOURS_PER_DAY)
    billed = F.col("sum_billable_hours")
    return totals.select(*PERIOD, planned.alias("planned"), *billed_hours()).select(
        *PERIOD,
        F.col("planned").alias("planned_billable_hours"),
        billed.alias("achieved_billable_hours"),
        (ratio(billed - F.col("planned"), billed, safe) * 100).alias("deviation"),
    )


def kpi_visibility(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Stored weekly snapshots whose Monday is in the range: billable by available hours, in percent."""
    monday = iso_week_monday(F.col("year"), F.col("week"))
    return t.reporting_visibility.filter(monday.between(F.lit(start), F.lit(end))).select(
        "week",
        "year",
        monday.alias("week_date"),
        (ratio(F.col("billable_hours"), F.col("available_hours"), safe) * 100).alias("percent"),
    )


# Invoicing


def _of_invoices(children: DataFrame, invoices: DataFrame) -> DataFrame:
    """Children of the given invoices. They are hashed by invoice here, as the sums per invoice need them to be."""
    asked = invoices.select(F.col("id").alias("_id"))
    return children.join(asked, F.col("invoice_balance") == F.col("_id"), "left_semi")


def _expenses_per_invoice(expense: DataFrame) -> DataFrame:
    amount = F.col("amount")

    def of(kind: str) -> Column:
        return F.when(F.col("type") == kind, amount)

    return (
        expense.filter(F.col("type").isNotNull())
        .groupBy(F.col("invoice_balance").alias("id"))
        .agg(
            F.sum(amount).alias("expense"),
            F.sum(of("subcontractor")).alias("subcontractor"),
            F.sum(of("other")).alias("other"),
            F.count(F.when(F.col("type") == "subcontractor", 1)).alias("subcontractors"),
            F.count(F.when(F.col("type") == "other", 1)).alias("others"),
        )
    )


def _write_offs_per_invoice(write_off: DataFrame) -> DataFrame:
    return write_off.groupBy(F.col("invoice_balance").alias("id")).agg(
        F.sum("minutes").alias("write_off"), F.count("*").alias("write_offs")
    )


def _invoices(t: Tables, periods: Periods) -> DataFrame:
    """Invoices of the span with their expenses and write-offs folded to one row each. Children of other invoices are
    left out before they are folded, if the span is known."""
    invoices = periods.restrict(t.invoice_balance).select("id", "project", "date", "amount", "minutes", "status")
    expense, write_off = t.expense, t.write_off
    if periods.span_days is not None:
        expense, write_off = _of_invoices(expense, invoices), _of_invoices(write_off, invoices)
    return invoices.join(_expenses_per_invoice(expense), "id", "left").join(
        _write_offs_per_invoice(write_off), "id", "left"
    )


def _money(column: Column) -> Column:
    return column.cast("double")


def accumulated_reconciliation(t: Tables, periods: Periods) -> DataFrame:
    """Company totals of invoices per period. Hours are whole (truncated) except written-off hours;
    subcontractor hours are those of invoices with any expense."""
    zero = F.lit(0).cast("decimal(10,2)")
    daily = (
        _invoices(t, periods)
        .groupBy("date")
        .agg(
            F.sum("write_off").alias("write_off"),
            F.sum("minutes").alias("minutes"),
            F.sum("amount").alias("amount"),
            F.count("*").alias("n"),
            F.sum(F.when(F.col("expense").isNotNull(), F.col("minutes")).otherwise(0)).alias("subcontractor_minutes"),
            F.sum(F.coalesce("subcontractor", zero)).alias("subcontractor"),
            F.sum(F.coalesce("other", zero)).alias("other"),
        )
    )
    measures = ("write_off", "minutes", "amount", "n", "subcontractor_minutes", "subcontractor", "other")
    return periods.total(daily, *measures).select(
        *PERIOD,
        (F.col("write_off") / F.lit(60.0)).alias("write_off"),
        F.expr("minutes div 60").alias("hours"),
        _money(F.col("amount")).alias("amount"),
        _money(F.col("amount") - (F.col("subcontractor") + F.col("other"))).alias("amount_net"),
        F.coalesce("n", F.lit(0)).alias("count"),
        F.expr("subcontractor_minutes div 60").alias("subcontractor_hours"),
        _money(F.col("subcontractor")).alias("subcontractor_expense"),
        _money(F.col("other")).alias("other_expense"),
    )


def ot(t: Tables, periods: Periods, safe: bool = False) -> DataFrame:
    """Achieved hourly price: net invoiced amount by billed hours. No row without billed hours."""
    return (
        accumulated_reconciliation(t, periods)
        .join(accumulated_billed_hours(t, periods), list(PERIOD))
        .select(
            *PERIOD,
            "write_off",
            F.col("hours").alias("invoice_hours"),
            F.col("amount").alias("amount_gross"),
            "amount_net",
            "subcontractor_hours",
            "subcontractor_expense",
            F.col("sum_billable_hours").alias("billable_hours"),
            ratio(F.col("amount_net"), F.col("sum_billable_hours"), safe).alias("ot"),
        )
    )


def ot_rolling(t: Tables, start: dt.date, end: dt.date, months: int = 6, safe: bool = False) -> DataFrame:
    windows = Periods.month_windows(t.spark, start, end, months)
    return ot(t, windows, safe).withColumnsRenamed({"from_date": "from_d", "to_date": "to_d"})


def kpi_accumulated_ot(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    windows = Periods.year_to_date(t.spark, start, end)
    return ot(t, windows, safe).select(
        F.col("from_date").alias("sum_start_date"), F.col("to_date").alias("sum_end_date"), F.col("ot").alias("summed_ot")
    )


def _invoice_groups(t: Tables, periods: Periods, fan_out: bool) -> DataFrame:
    """Expense and write-off sums per period, project, status, minutes and amount of invoices; money still exact."""
    invoices = _invoices(t, periods)
    if fan_out:
        # What joining all children of an invoice before summing gives, without building the pairs:
        # each sum is multiplied by the numbers of its siblings.
        def copies(*counts: str) -> Column:
            product = F.lit(1)
            for name in counts:
                product = product * F.greatest(F.coalesce(name, F.lit(0)), F.lit(1)).cast("int")
            return product

        invoices = (
            invoices.withColumn("write_off", F.col("write_off") * copies("others", "subcontractors"))
            .withColumn("other", (F.col("other") * copies("write_offs", "subcontractors")).cast("decimal(38,2)"))
            .withColumn("subcontractor", (F.col("subcontractor") * copies("write_offs", "others")).cast("decimal(38,2)"))
        )
    return (
        invoices.join(periods.days(), "date")
        .groupBy(*PERIOD, F.col("project").alias("id"), "status", "minutes", "amount")
        .agg(F.sum("write_off").alias("write_off"), F.sum("other").alias("other"), F.sum("subcontractor").alias("subcontractor"))
    )


def _project_economics(t: Tables, periods: Periods, fan_out: bool) -> DataFrame:
    """Invoice, expense and entry sums per period and billable project, and of its invoices per status, minutes and
    amount.

    A project carries its minutes of each day and the periods in which it has invoices, which the calendar and the
    periods bound, so pairs of project and period are made last and never shuffled: only those with invoices are joined.
    """
    grouped = _invoice_groups(t, periods, fan_out)
    daily = (
        periods.restrict(t.time_entry)
        .groupBy(F.col("project").alias("id"), "date")
        .agg(F.sum("minutes").alias("minutes"))
        .groupBy("id")
        .agg(F.collect_set(F.struct("date", "minutes")).alias("_days"))
    )
    invoiced = (
        periods.restrict(t.invoice_balance)
        .select(F.col("project").alias("id"), "date")
        .distinct()
        .join(periods.days(), "date")
        .groupBy("id")
        .agg(F.collect_set(F.struct(*PERIOD)).alias("_invoiced"))
    )
    billable = t.projects.filter(F.col("billable") == BILLABLE).select("id")
    projects = billable.join(daily, "id", "left").join(invoiced, "id", "left")

    def entered(rows: DataFrame) -> DataFrame:
        inside = F.filter("_days", lambda day: day["date"].between(F.col("from_date"), F.col("to_date")))
        minutes = F.aggregate(inside, F.lit(0).cast("long"), lambda sofar, day: sofar + F.coalesce(day["minutes"], F.lit(0)))
        return rows.select("id", *PERIOD, minutes.alias("time_entry_minutes"))

    pair = F.struct(*PERIOD)
    plain = entered(periods.attach(projects).filter(F.col("_invoiced").isNull() | ~F.array_contains("_invoiced", pair)))
    of_invoices = entered(projects.select("*", F.inline("_invoiced"))).join(grouped, ["id", *PERIOD])
    return of_invoices.unionByName(plain, allowMissingColumns=True)


def hours_per_project(t: Tables, periods: Periods, fan_out: bool = True) -> DataFrame:
    """Invoices, expenses, write-offs and entered minutes of every billable project, per period.

    A project has one row per distinct (status, minutes, amount) of its invoices. By default sums are
    those of joining all children of an invoice before summing, so siblings multiply each other;
    ``fan_out=False`` counts every child once.
    """
    zero = F.lit(0)
    return _project_economics(t, periods, fan_out).select(
        F.col("id").alias("project"),
        "status",
        F.coalesce("time_entry_minutes", zero).alias("time_entry_minutes"),
        F.coalesce("minutes", zero).alias("invoice_balance_minutes"),
        _money(F.coalesce("amount", zero)).alias("invoice_balance_money"),
        F.coalesce("write_off", zero).alias("write_off_minutes"),
        _money(F.coalesce("other", zero)).alias("expense_money"),
        _money(F.coalesce("subcontractor", zero)).alias("subcontractor_money"),
        F.col("from_date").alias("start_date"),
        F.col("to_date").alias("end_date"),
    )


def _economics_totals(t: Tables, windows: Periods, fan_out: bool) -> DataFrame:
    """Sums over the rows of ``hours_per_project`` per window, without those rows.

    Only invoices make rows of project and window. Entered minutes are summed per window; a project with several groups
    of invoices has a row for each, so its minutes are added once more for each group beyond the first. A window has a
    row if there is a billable project at all.
    """
    money = ("amount", "minutes", "write_off", "other", "subcontractor")
    billable = t.projects.filter(F.col("billable") == BILLABLE).select("id")
    per_project = (
        _invoice_groups(t, windows, fan_out)
        .join(billable, "id", "left_semi")
        .groupBy(*PERIOD, "id")
        .agg(*[F.sum(name).alias(name) for name in money], (F.count("*") - 1).alias("again"))
    )
    sums = per_project.groupBy(*PERIOD).agg(*[F.sum(name).alias(name) for name in money])
    entries = windows.restrict(t.time_entry).select(F.col("project").alias("id"), "date", "minutes")
    once = windows.sum_by(entries.join(billable, "id", "left_semi"), entered=F.col("minutes"))
    several = per_project.filter("again > 0").select(*PERIOD, "id", "again")
    of_several = entries.join(several.select("id").distinct(), "id", "left_semi")
    more = (
        windows.sum_by(of_several, "id", extra=F.col("minutes"))
        .join(several, [*PERIOD, "id"])
        .groupBy(*PERIOD)
        .agg(F.sum(F.col("extra") * F.col("again")).alias("extra"))
    )
    some = billable.select(F.lit(1).alias("_some")).limit(1)
    asked = windows.df.select(*PERIOD, F.lit(1).alias("_some")).join(some, "_some", "left_semi").drop("_some")
    totals = asked
    for part in (sums, once, more):
        totals = totals.join(part, list(PERIOD), "left")
    zero = F.lit(0)
    minutes = F.coalesce("entered", zero) + F.coalesce("extra", zero)
    return totals.withColumn("time_entry_minutes", minutes).select(
        *PERIOD, *[F.coalesce(name, zero).cast("decimal(38,2)").alias(name) for name in (*money, "time_entry_minutes")]
    )


def kpi_ul(t: Tables, start: dt.date, end: dt.date, fan_out: bool = True, safe: bool = False) -> DataFrame:
    """Subcontractor money by invoiced money per six-month window."""
    totals = _economics_totals(t, Periods.month_windows(t.spark, start, end), fan_out)
    share = ratio(_money(F.col("subcontractor")), _money(F.col("amount")), safe)
    return totals.select(*PERIOD, share.alias("payload"))


def monthly_balance_summary(t: Tables, start: dt.date, end: dt.date, fan_out: bool = True) -> DataFrame:
    """Project economics summed over all billable projects, per month before each month touched."""
    totals = _economics_totals(t, Periods.month_windows(t.spark, start, end, 1), fan_out)
    return totals.select(
        *PERIOD,
        _money(F.col("amount")).alias("invoice_money"),
        _money(F.col("minutes")).alias("invoice_balance_minutes"),
        _money(F.col("time_entry_minutes")).alias("time_entry_minutes"),
        _money(F.col("write_off")).alias("write_off_minutes"),
        _money(F.col("other")).alias("expense_money"),
        _money(F.col("subcontractor")).alias("subcontractor_money"),
    )


# Customers that depend on one person


def unaccompanied_customer_involvement(t: Tables, periods: Periods, safe: bool = False) -> DataFrame:
    """Customers with exactly one employee who spent over half of their available hours there.
    ``employee_count`` holds that employee's id."""
    minutes = F.col("minutes")
    worked = periods.restrict(t.time_entry).join(
        project_classes(t).select("project", "customer", "billable"), "project"
    )
    involved = (
        periods.sum_by(
            worked,
            "employee",
            "customer",
            billable=F.when(F.col("billable") == BILLABLE, minutes).otherwise(0),
            unavailable=F.when(F.col("billable") == UNAVAILABLE, minutes).otherwise(0),
        )
        .filter(F.col("billable") > 0)
        .join(
            t.employees.select(F.col("id").alias("employee"), "date_of_employment", "termination_date"), "employee"
        )
    )
    available = F.col("workdays_employed") * F.lit(HOURS_PER_DAY) - F.col("unavailable") / F.lit(60.0)
    return (
        with_available_days(involved, t, periods)
        .filter(ratio(F.col("billable") / F.lit(60.0), available, safe) > 0.5)
        .groupBy(*PERIOD, F.col("customer").alias("customer_id"))
        .agg(F.count("*").alias("n"), F.sum("employee").cast("int").alias("employee_count"))
        .filter(F.col("n") == 1)
        .drop("n")
    )


def unaccompanied_customer_involvement_kpi(t: Tables, start: dt.date, end: dt.date, safe: bool = False) -> DataFrame:
    """Such customers by permanent employees per two-month window; a window without any has no row."""
    windows = Periods.month_windows(t.spark, start, end, 2)
    customers = unaccompanied_customer_involvement(t, windows, safe).groupBy(*PERIOD).agg(F.count("*").alias("customers"))
    return customers.join(number_of_employees_in_periods(t, windows), list(PERIOD)).select(
        *PERIOD, ratio(F.col("customers"), F.col("employee_count"), safe).alias("percent")
    )
