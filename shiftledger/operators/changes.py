"""Batches of changes: requests in, a new table version out.

A batch has one row per request and an integer ``seq``; the result is what running the requests one
after the other in that order would leave. Nothing is updated in place: each operator returns the new
table(s), the rows that a single request would report back, and where it applies the rejected
requests. Write the new version with ``write_snapshot`` and switch readers to it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.functions.codes import (
    class_from_flag,
    flag_from_class,
    is_absence_reason,
)
from shiftledger.functions.dates import days_between, is_weekday, iso_week_monday
from shiftledger.operators.calendar import only_holidays, without_holidays
from shiftledger.operators.capacity import available_dates
from shiftledger.operators.contracts import FOREIGN_KEYS
from shiftledger.operators.dimensions import absence_reasons
from shiftledger.sources.tables import Tables

STAFFING_KEY = ("employee", "project", "date")


@dataclass(frozen=True)
class Change:
    """Result of a batch: new table versions by name, reported rows, rejected requests."""

    tables: dict[str, DataFrame]
    returned: DataFrame
    rejected: DataFrame | None = None


def _reason_ids(t: Tables) -> DataFrame:
    """Absence codes; nine ids at most, so always broadcast."""
    return F.broadcast(absence_reasons(t).select(F.col("id").alias("project")).distinct())


def _request_days(requests: DataFrame) -> DataFrame:
    days = F.explode(days_between(F.col("start_date"), F.col("end_date")))
    return requests.withColumn("date", days).drop("start_date", "end_date")


def _first_per_key(rows: DataFrame, *keys: str, last: bool = False) -> DataFrame:
    """The first (or last) request per key, folded inside each task, so a key that many requests share does
    not have to be gathered."""
    others = [c for c in rows.columns if c not in keys and c != "seq"]
    extreme, at_extreme = (F.max, F.max_by) if last else (F.min, F.min_by)
    return rows.groupBy(*keys).agg(extreme("seq").alias("seq"), *[at_extreme(c, "seq").alias(c) for c in others])


def _as_staffing(rows: DataFrame) -> DataFrame:
    return rows.select("employee", "project", "date", "percentage")


def _as_absence(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("employee").alias("employee_id"), "date", F.col("project").alias("reason"), "percentage"
    )


def _absence_keys(t: Tables) -> DataFrame:
    return t.absence.select(F.col("employee_id").alias("employee"), F.col("reason").alias("project"), "date")


# Staffing by range


def add_staffing_in_period(t: Tables, requests: DataFrame) -> Change:
    """Plan every weekday of (seq, employee, project, start_date, end_date, percentage) requests, as absence
    when the project is an absence code and as staffing otherwise. Holidays are not skipped, existing
    rows stay, and the start date is always part of the range."""
    reasons = _reason_ids(t)
    until = F.greatest("start_date", "end_date")
    wanted = _request_days(requests.withColumn("end_date", until)).filter(is_weekday(F.col("date")))
    first = _first_per_key(wanted, *STAFFING_KEY)
    to_staffing = first.join(reasons, "project", "left_anti").join(
        t.staffing.select(*STAFFING_KEY), list(STAFFING_KEY), "left_anti"
    )
    to_absence = first.join(reasons, "project", "left_semi").join(_absence_keys(t), list(STAFFING_KEY), "left_anti")
    return Change(
        {
            "staffing": _as_staffing(t.staffing).unionByName(_as_staffing(to_staffing)),
            "absence": _as_absence_table(t).unionByName(_as_absence(to_absence)),
        },
        to_staffing.unionByName(to_absence).select("seq", "employee", "project", "date"),
    )


def _as_absence_table(t: Tables) -> DataFrame:
    return t.absence.select("employee_id", "date", "reason", "percentage")


def remove_staffing_in_period(t: Tables, requests: DataFrame) -> Change:
    """Remove the weekdays of (seq, employee, project, start_date, end_date) requests from absence or
    staffing, whichever the project belongs to."""
    reasons = _reason_ids(t)
    wanted = _first_per_key(
        _request_days(requests.select("seq", "employee", "project", "start_date", "end_date")).filter(
            is_weekday(F.col("date"))
        ),
        *STAFFING_KEY,
    )
    from_staffing = wanted.join(reasons, "project", "left_anti")
    from_absence = wanted.join(reasons, "project", "left_semi")
    removed = from_staffing.join(t.staffing.select(*STAFFING_KEY), list(STAFFING_KEY), "left_semi").unionByName(
        from_absence.join(_absence_keys(t), list(STAFFING_KEY), "left_semi")
    )
    absence_days = from_absence.select(F.col("employee").alias("employee_id"), F.col("project").alias("reason"), "date")
    return Change(
        {
            "staffing": _as_staffing(t.staffing.join(from_staffing, list(STAFFING_KEY), "left_anti")),
            "absence": t.absence.join(absence_days, ["employee_id", "reason", "date"], "left_anti").select(
                "employee_id", "date", "reason", "percentage"
            ),
        },
        removed.select("seq", "employee", "project", "date"),
    )


def _split_absence_requests(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    reasons = _reason_ids(t)
    return requests.join(reasons, "project", "left_anti"), requests.join(reasons, "project", "left_semi")


def insert_staffing(t: Tables, requests: DataFrame) -> Change:
    """Plan every working day of the requests; existing rows stay. Absence codes are rejected."""
    accepted, rejected = _split_absence_requests(t, requests)
    days = without_holidays(_request_days(accepted).filter(is_weekday(F.col("date"))), t.holidays)
    new = _first_per_key(days, *STAFFING_KEY).join(
        t.staffing.select(*STAFFING_KEY), list(STAFFING_KEY), "left_anti"
    )
    return Change(
        {"staffing": _as_staffing(t.staffing).unionByName(_as_staffing(new))},
        new.select("seq", "employee", "project", "date"),
        rejected,
    )


def _month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _day_bits(first: Column, last: Column) -> Column:
    """The days of a range inside one month, a bit for each."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, F.dayofmonth(last)) - F.call_function("shiftleft", one, F.dayofmonth(first) - 1)


def _by_month(requests: DataFrame) -> DataFrame:
    """Requests cut at the ends of months: the days from _first to _last, and as bits, lie in _month."""
    start, end = F.col("start_date"), F.col("end_date")
    months = F.explode(F.when(start <= end, F.sequence(_month_number(start), _month_number(end))))
    month_start = F.make_date(F.floor(F.col("_month") / 12).cast("int"), F.col("_month") % 12 + 1, F.lit(1))
    return (
        requests.withColumn("_month", months)
        .withColumn("_first", F.greatest(start, month_start))
        .withColumn("_last", F.least(end, F.last_day(month_start)))
        .withColumn("_days", _day_bits(F.col("_first"), F.col("_last")))
        .drop("start_date", "end_date")
    )


def upsert_staffing(t: Tables, requests: DataFrame) -> Change:
    """Replace the plan of the requests' ranges: everything in the range goes, working days come back with
    the new percentage. For each day the last request counts. Absence codes are rejected and change
    nothing.

    Ranges are cut by month and become days last. With a bit for each day, a request keeps those that no later one of
    its employee, project and month has, and stored rows meet one set of covered days.
    """
    accepted, rejected = _split_absence_requests(t, requests)
    key, date, days = ("employee", "project", "_month"), F.col("date"), F.col("_days")
    asked = _by_month(accepted.select("seq", "employee", "project", "start_date", "end_date", "percentage"))
    later = (
        Window.partitionBy(*key)
        .orderBy(F.desc_nulls_last("seq"), F.desc_nulls_last("percentage"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lasting = (
        asked.withColumn("_days", days.bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("_days").over(later), F.lit(0).cast("long")))))
        .filter(days != 0)
        .withColumn("date", F.explode(F.sequence("_first", "_last")))
        .filter(is_weekday(date) & (days.bitwiseAND(_day_bits(date, date)) != 0))
    )
    new = without_holidays(lasting, t.holidays).withColumn("percentage", F.when(F.col("seq").isNotNull(), F.col("percentage")))
    covered = asked.groupBy(*key).agg(F.bit_or("_days").alias("_days"))
    kept = (
        t.staffing.withColumn("_month", _month_number(date))
        .join(covered, list(key), "left")
        .filter(F.coalesce(days.bitwiseAND(_day_bits(date, date)), F.lit(0).cast("long")) == 0)
    )
    reported = without_holidays(_request_days(accepted).filter(is_weekday(F.col("date"))), t.holidays)
    return Change(
        {"staffing": _as_staffing(kept).unionByName(_as_staffing(new))},
        reported.select("seq", "employee", "project", "date"),
        rejected,
    )


def remove_staffing(t: Tables, requests: DataFrame) -> Change:
    """Remove the ranges of (seq, employee, project, start_date, end_date) requests; without an end date,
    everything from the start. A removed day is reported by the first request that covers it.

    Closed ranges are days, folded to the first request of each. Of open ranges a day is reported by the
    least seq among the starts up to it: a running minimum over the days of one employee and project.
    """
    closed = requests.filter(F.col("end_date").isNotNull()).select("seq", *STAFFING_KEY[:2], "start_date", "end_date")
    by_day = _first_per_key(_request_days(closed), *STAFFING_KEY).withColumnRenamed("seq", "_closed")
    staffed = t.staffing.select(*STAFFING_KEY, F.lit(True).alias("_staffed"), F.lit(None).cast("int").alias("_open"))
    starts = requests.filter(F.col("end_date").isNull() & F.col("start_date").isNotNull()).select(
        "employee", "project", F.col("start_date").alias("date"), F.lit(None).cast("boolean").alias("_staffed"),
        F.col("seq").alias("_open"),
    )
    days = staffed.unionByName(starts).groupBy(*STAFFING_KEY).agg(F.max("_staffed").alias("_staffed"), F.min("_open").alias("_open"))
    so_far = Window.partitionBy("employee", "project").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    removed = (
        days.withColumn("_open", F.min("_open").over(so_far))
        .filter("_staffed")
        .join(by_day, list(STAFFING_KEY), "left")
        .withColumn("seq", F.least("_open", "_closed"))
        .filter("seq is not null")
        .select("seq", *STAFFING_KEY)
    )
    kept = t.staffing.join(removed.select(*STAFFING_KEY), list(STAFFING_KEY), "left_anti")
    return Change({"staffing": _as_staffing(kept)}, removed)


# Staffing by week

# More days than any week has: what a request without a number of days asks for.
ALL_DAYS = 366


def _asking(requests: DataFrame) -> DataFrame:
    """Requests for some days, or for all (no number given)."""
    return requests.filter(F.coalesce(F.col("days") > 0, F.lit(True)))


def _in_turn(requests: DataFrame, *week: str) -> DataFrame:
    """Give each request the days after those of earlier requests for the same week: positions above _after
    up to _upto. Without ``days`` a request takes all that are left. The sum runs over the requests of one
    employee for one week.
    """
    order = Window.partitionBy(*week).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    asked = requests.withColumn("days", F.coalesce(F.col("days").cast("long"), F.lit(ALL_DAYS)))
    return asked.withColumn("_upto", F.sum("days").over(order)).withColumn("_after", F.col("_upto") - F.col("days"))


def add_staffing_in_week(t: Tables, requests: DataFrame) -> Change:
    """Plan the first ``days`` free working days of a week, at 100 percent, for (seq, employee, project, year,
    week, days) requests. Free means no staffing and no absence.

    Requests of one employee for the same week follow one another: the free days, at most five, are
    numbered and handed out in order, so no two requests get the same day.
    """
    asked = _asking(requests).withColumn("monday", iso_week_monday(F.col("year"), F.col("week")))
    numbered = _in_turn(asked, "employee", "monday")
    weeks = asked.select("employee", "year", "week", "monday").dropDuplicates(["employee", "monday"])
    free = available_dates(t, weeks).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("employee", "monday").orderBy("available_date"))
    )
    in_turn = (F.col("_rank") > F.col("_after")) & (F.col("_rank") <= F.col("_upto"))
    given = numbered.join(free.select("employee", "monday", "available_date", "_rank"), ["employee", "monday"]).filter(
        in_turn
    )
    new = given.select(
        "seq", "employee", "project", F.col("available_date").alias("date"), F.lit(100).alias("percentage")
    )
    return Change(
        {"staffing": _as_staffing(t.staffing).unionByName(_as_staffing(new))},
        new.select("seq", "employee", "project", "date"),
    )


def remove_staffing_in_week(t: Tables, requests: DataFrame) -> Change:
    """Remove the latest ``days`` staffed days of a week for (seq, employee, project, year, week, days)
    requests. The week is named by calendar year and ISO week number.

    Requests for the same employee, project and week follow one another, each taking the days left.
    """
    key = ["employee", "project", "year", "week"]
    numbered = _in_turn(_asking(requests), *key)
    wanted = requests.select(*key).distinct()
    staffed = (
        t.staffing.withColumn("year", F.year("date"))
        .withColumn("week", F.weekofyear("date"))
        .join(wanted, key, "left_semi")
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("date"))))
    )
    removed = (
        staffed.select(*key, "date", "_rank")
        .join(numbered.select("seq", *key, "_after", "_upto"), key)
        .filter((F.col("_rank") > F.col("_after")) & (F.col("_rank") <= F.col("_upto")))
        .select("seq", "employee", "project", "date")
    )
    return Change(
        {"staffing": _as_staffing(t.staffing.join(removed, list(STAFFING_KEY), "left_anti"))},
        removed,
    )


def fix_staffing_on_weekends_and_holidays(t: Tables) -> Change:
    """Move staffing on weekends and holidays to free days of the same week, earliest day first, at 100
    percent, and drop the originals. Reported are the groups in a week without any free day.

    Free days are those before the batch, so two projects of one employee can land on the same day.
    Days beyond the number of free days are dropped with the originals.
    """
    weekend = t.staffing.filter(~is_weekday(F.col("date")))
    weekday = t.staffing.filter(is_weekday(F.col("date")))
    misplaced = weekend.unionByName(only_holidays(weekday, t.holidays).select(*t.staffing.columns))
    groups = misplaced.groupBy(
        "employee", "project", F.year("date").alias("year"), F.weekofyear("date").alias("week")
    ).agg(F.count("*").cast("int").alias("count"))
    weeks = groups.select("employee", "year", "week").distinct()
    free = available_dates(t, weeks).withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("employee", "year", "week").orderBy("available_date")),
    )
    moved = (
        groups.join(free, ["employee", "year", "week"])
        .filter(F.col("_rank") <= F.col("count"))
        .select("employee", "project", F.col("available_date").alias("date"), F.lit(100).alias("percentage"))
        .dropDuplicates(list(STAFFING_KEY))
    )
    stuck = groups.join(free, ["employee", "year", "week"], "left_anti").select(
        "employee", "year", "week", "count", "project"
    )
    return Change(
        {"staffing": _as_staffing(without_holidays(weekday, t.holidays)).unionByName(_as_staffing(moved))}, stuck
    )


# Time locks


def _newest_lock(events: DataFrame) -> DataFrame:
    newest = F.max(F.struct(F.col("created").isNull().alias("_open"), "created", "id", "creator", "commit_date"))
    return (
        events.groupBy("employee")
        .agg(newest.alias("_newest"))
        .select("_newest.id", "_newest.created", "_newest.creator", "employee", "_newest.commit_date")
    )


def latest_timelocks(t: Tables) -> DataFrame:
    """The newest lock event of each employee. A missing creation time counts as newest; equal times go to
    the largest id."""
    return _newest_lock(t.timelock_events)


def merged_timelocks(stored: DataFrame, events: DataFrame) -> DataFrame:
    """The newest lock event of each employee, from those stored after earlier events and from new events alone.

    Old events are not read again: the newest of all is the newest of the stored one and the new ones, whatever order
    they arrive in and even if some arrive twice.
    """
    columns = ("id", "created", "creator", "employee", "commit_date")
    return _newest_lock(stored.select(*columns).unionByName(events.select(*columns)))


# Requests of a block in the order of seq, most blocks, and groups of employees: a block and a group make a cell. And days
# under which entries and ranges are filed.
LOCK_BLOCK, LOCK_BLOCKS, LOCK_GROUPS, LOCK_DAYS = 1 << 16, 64, 8, 16


def _touched(t: Tables, requests: DataFrame) -> DataFrame:
    """Each request once for each employee with entries on its project in its range, laid out by cell.

    Entries are filed under their stretch of days and a range under all that it touches, so that the two meet by
    equality. Of several days of an employee inside the range only the first meets it: the day before lies outside.
    Pairs are far more than entries and requests. So these are copied to the cells that need them, and pairs are made
    in the partition of their cell, where their order can be found without a shuffle. A join would shuffle them again.
    """
    dated = t.time_entry.select("employee", "project", "date").dropna(subset=["project", "date"]).distinct()
    before = F.lag("date").over(Window.partitionBy("employee", "project").orderBy("date"))

    def stretch(date: Column) -> Column:
        return F.floor(F.unix_date(date) / LOCK_DAYS)

    def cell(group: Column) -> Column:
        return (F.col("_block") * LOCK_GROUPS + group).alias("_cell")

    start, end = F.col("start_date"), F.col("end_date")
    # bounds that come out the same whenever they are computed, as percentiles would not
    blocks = F.least(F.lit(LOCK_BLOCKS), F.ceil(F.count("*") / LOCK_BLOCK)).alias("_blocks")
    bounds = requests.agg(F.min("seq").cast("double").alias("_low"), F.max("seq").cast("double").alias("_high"), blocks)
    share = (F.col("seq").cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1)
    block = F.floor(share * F.col("_blocks")).alias("_block")
    in_blocks = requests.crossJoin(F.broadcast(bounds)).select(*requests.columns, block)
    asked = in_blocks.filter(start <= end)
    stretches = F.sequence(stretch(start), stretch(end))
    days = dated.withColumn("_previous", before).withColumn("_stretch", stretch(F.col("date")))
    held = asked.select("project", "_block", F.explode(stretches).alias("_stretch")).distinct()
    key = ["_cell", "_block", "project"]
    of_days = days.join(held, ["project", "_stretch"]).select(
        *key[1:],
        F.struct("employee", "date", "_previous").alias("_day"),
        F.array("_stretch").alias("_stretches"),
        cell(F.pmod(F.hash("employee"), F.lit(LOCK_GROUPS))),
    )
    of_asked = asked.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(LOCK_GROUPS - 1)))).select(
        *key[1:], F.struct(*(c for c in requests.columns if c != "project")).alias("_request"), cell(F.col("_group"))
    )
    request = F.col("_request")
    reached = F.sequence(stretch(request["start_date"]), stretch(request["end_date"]))
    met = (
        of_days.unionByName(of_asked, allowMissingColumns=True)
        .repartition(LOCK_BLOCKS * LOCK_GROUPS, "_cell")
        .select(*key, "_day", "_request", F.explode(F.coalesce("_stretches", reached)).alias("_stretch"))
        .groupBy(*key, "_stretch")
        .agg(F.collect_list("_day").alias("_days"), F.collect_list("_request").alias("_requests"))
        .select(*key, "_requests", F.explode("_days").alias("_day"))
        .select(*key, "_day", F.explode("_requests").alias("_request"))
    )
    first = F.col("date").between(start, end) & (F.col("_previous").isNull() | (F.col("_previous") < start))
    return met.select(*key, "_day.*", "_request.*").filter(first)


def lock_employee_hours(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Lock events for (seq, project, start_date, end_date, commit_date, creator) requests: one for each
    employee with entries on the project in the range, unless the newest event of the employee already
    has this commit date. Within a batch a request sees the events of those before it. Requests without seq and
    entries without employee have no place in that order and lock nothing."""
    asked = requests.select("seq", "project", "start_date", "end_date", "commit_date", "creator").dropna(subset=["seq"])
    # an order that leaves none open, since touched is computed twice
    in_cell = Window.partitionBy("employee", "_cell").orderBy("seq", "commit_date", "creator")
    touched = (
        _touched(t, asked)
        .filter("employee IS NOT NULL")
        .select("seq", "employee", "creator", "commit_date", "_cell", "_block")
        .withColumn("_before", F.lag("commit_date").over(in_cell))
        .withColumn("_first", F.lag("seq").over(in_cell).isNull())
        .withColumn("_last", F.lead("seq").over(in_cell).isNull())
    )
    # Most requests follow another of their cell. Only the others, with the last of each cell, are shuffled: what was
    # committed before them is the last of the blocks before, else in the table.
    latest = latest_timelocks(t).select("employee", F.col("commit_date").alias("_latest"))
    in_turn = Window.partitionBy("employee").orderBy("_block", F.desc("_first"), "_last", "seq")
    earlier = F.when(F.col("_first"), F.lag("commit_date").over(in_turn))
    edges = touched.filter(F.col("_before").isNull() | F.col("_last")).withColumn("_earlier", earlier)
    open_ones = edges.filter(F.col("_before").isNull()).join(latest, "employee", "left")
    others = touched.filter(F.col("_before").isNotNull())
    new = (
        others.filter(~F.col("_before").eqNullSafe(F.col("commit_date")))
        .select("seq", "employee", "creator", "commit_date")
        .unionByName(
            open_ones.filter(~F.coalesce("_earlier", "_latest").eqNullSafe(F.col("commit_date"))).select(
                "seq", "employee", "creator", "commit_date"
            )
        )
        .select(
            "seq",
            F.sha2(F.concat_ws("|", F.lit(now.isoformat()), "seq", "employee", "commit_date"), 256).alias("id"),
            F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz").alias("created"),
            "creator",
            "employee",
            "commit_date",
        )
    )
    columns = ("id", "created", "creator", "employee", "commit_date")
    return Change(
        {"timelock_events": t.timelock_events.select(*columns).unionByName(new.select(*columns))},
        new.select("seq", "employee", "commit_date", "creator"),
    )


# Invoices

INVOICE_COLUMNS = ("id", "project", "date", "amount", "minutes", "created", "invoicenumber", "status")


def invoice_key(project: Column, date: Column) -> Column:
    """Key of a new invoice balance, the same whichever batch creates it."""
    return F.sha2(F.concat_ws("|", project, date.cast("string")), 256)


def _merge_invoices(t: Tables, changes: DataFrame, today: dt.date, *updated: str) -> DataFrame:
    """Insert or update invoices by (project, date). New rows take defaults for columns not given."""
    defaults = {
        "id": invoice_key(F.col("project"), F.col("date")),
        "amount": F.lit(0).cast("decimal(10,2)"),
        "minutes": F.lit(0),
        "created": F.lit(today),
        "invoicenumber": F.lit(None).cast("string"),
        "status": F.lit("not_done"),
    }
    given = changes.select("project", "date", F.lit(True).alias("_given"), *[F.col(c).alias(f"_{c}") for c in updated])
    merged = t.invoice_balance.select(*INVOICE_COLUMNS).join(given, ["project", "date"], "full_outer")

    def value(column: str) -> Column:
        if column in ("project", "date"):
            return F.col(column)
        if column == "invoicenumber":
            return F.col(column)
        kept = F.coalesce(F.col(column), defaults[column])
        if column in updated:
            kept = F.when(F.col("_given"), F.coalesce(f"_{column}", defaults[column])).otherwise(kept)
        return kept.alias(column)

    return merged.select(*[value(c) for c in INVOICE_COLUMNS])


def _complete(changes: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Changes with a value in each of the columns, and the others: the tables take no NULL there."""
    whole = F.lit(True)
    for column in columns:
        whole = whole & F.col(column).isNotNull()
    asked = changes.select("seq", *columns)
    return asked.filter(whole), asked.filter(~whole)


def _reported(changes: DataFrame, invoices: DataFrame, *columns: str) -> DataFrame:
    """Every change with the id of its invoice, also those that a later one replaces."""
    ids = invoices.select("project", "date", F.col("id").alias("invoice_balance"))
    return changes.select("seq", "project", "date", *columns).join(ids, ["project", "date"])


def _upsert_invoices(t: Tables, changes: DataFrame, today: dt.date, *updated: str) -> Change:
    accepted, rejected = _complete(changes, "project", "date", *updated)
    last = _first_per_key(accepted, "project", "date", last=True)
    invoices = _merge_invoices(t, last, today, *updated)
    returned = _reported(accepted, invoices).withColumnRenamed("invoice_balance", "id")
    return Change({"invoice_balance": invoices}, returned.select("seq", "project", "date", "id"), rejected)


def upsert_invoice_balance(t: Tables, changes: DataFrame, today: dt.date) -> Change:
    """Set minutes and amount of invoices by (seq, project, date, minutes, amount); the last change wins.
    Each change reports the invoice's id; one with a NULL is rejected."""
    return _upsert_invoices(t, changes, today, "minutes", "amount")


def upsert_invoice_status(t: Tables, changes: DataFrame, today: dt.date) -> Change:
    """Set the status of invoices by (seq, project, date, status); the last change wins. Each change reports
    the invoice's id; one with a NULL is rejected."""
    return _upsert_invoices(t, changes, today, "status")


def expense_key(invoice: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws("|", invoice, kind), 256)


def write_off_key(invoice: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("write_off"), invoice), 256)


def upsert_expense(t: Tables, changes: DataFrame, today: dt.date) -> Change:
    """Replace all expenses of (invoice, type) by one, for (seq, project, date, type, amount) changes; the
    last change wins. A missing invoice is created. Each change reports the expense's id; one with a NULL is
    rejected."""
    accepted, rejected = _complete(changes, "project", "date", "type", "amount")
    last = _first_per_key(accepted, "project", "date", "type", last=True)
    invoices = _merge_invoices(t, last.select("project", "date").distinct(), today)
    placed = _reported(last, invoices, "type", "amount")
    key = expense_key(F.col("invoice_balance"), F.col("type")).alias("id")
    new = placed.select(
        key,
        "invoice_balance",
        "type",
        F.col("amount").cast("decimal(10,2)").alias("amount"),
        F.lit(today).alias("created"),
        F.lit(None).cast("string").alias("comment"),
    )
    kept = t.expense.select(*new.columns).join(placed, ["invoice_balance", "type"], "left_anti").select(*new.columns)
    returned = _reported(accepted, invoices, "type").select("seq", "project", "date", "type", "invoice_balance", key)
    return Change({"invoice_balance": invoices, "expense": kept.unionByName(new)}, returned, rejected)


def upsert_write_off(t: Tables, changes: DataFrame, today: dt.date) -> Change:
    """Replace all write-offs of an invoice by one, for (seq, project, date, minutes) changes; the last change
    wins. A missing invoice is created. Each change reports the write-off's id; one with a NULL is rejected."""
    accepted, rejected = _complete(changes, "project", "date", "minutes")
    last = _first_per_key(accepted, "project", "date", last=True)
    invoices = _merge_invoices(t, last.select("project", "date"), today)
    placed = _reported(last, invoices, "minutes")
    key = write_off_key(F.col("invoice_balance")).alias("id")
    new = placed.select(key, "invoice_balance", "minutes", F.lit(today).alias("created"))
    kept = t.write_off.select(*new.columns).join(placed.select("invoice_balance"), "invoice_balance", "left_anti")
    returned = _reported(accepted, invoices).select("seq", "project", "date", "invoice_balance", key)
    return Change(
        {"invoice_balance": invoices, "write_off": kept.select(*new.columns).unionByName(new)}, returned, rejected
    )


# One-off moves and rewrites


def move_absence_out_of_staffing(t: Tables, skip_holidays: bool = False) -> Change:
    """Move staffing on absence codes to absence; absence rows that exist stay. The earlier form
    (``skip_holidays``) tests the code itself instead of the absence view and carries over neither holidays,
    though it removes them from staffing too, nor percentages."""
    if skip_holidays:
        is_reason = is_absence_reason(F.col("project"))
        moving, kept = t.staffing.filter(is_reason), t.staffing.filter(~is_reason)
        moving = without_holidays(moving, t.holidays).withColumn("percentage", F.lit(100))
    else:
        reasons = _reason_ids(t)
        moving = t.staffing.join(reasons, "project", "left_semi")
        kept = t.staffing.join(reasons, "project", "left_anti")
    new = moving.join(_absence_keys(t), list(STAFFING_KEY), "left_anti")
    return Change(
        {
            "staffing": _as_staffing(kept),
            "absence": _as_absence_table(t).unionByName(_as_absence(new)),
        },
        new.select("employee", "project", "date"),
    )


def billable_flag_to_class(projects: DataFrame) -> DataFrame:
    return projects.withColumn("billable", class_from_flag(F.col("billable")))


def billable_class_to_flag(projects: DataFrame) -> DataFrame:
    return projects.withColumn("billable", flag_from_class(F.col("billable")))


# Which columns follow a renamed key.
CASCADES = {
    "projects": (("time_entry", "project"), ("staffing", "project")),
    "employees": (("staffing", "employee"), ("projects", "responsible")),
    "customers": (("projects", "customer"),),
}


def _holding(t: Tables, parent: str) -> list[tuple[str, str]]:
    """(table, column) pairs that refer to a parent and do not follow a renamed key."""
    follows = CASCADES[parent]
    return [
        (child, column)
        for child, parents in FOREIGN_KEYS.items()
        if child in t
        for column in parents.get(parent, ())
        if (child, column) not in follows
    ]


def rename_keys(t: Tables, parent: str, mapping: DataFrame) -> Change:
    """Apply an (old_id, new_id) mapping to a parent table and to every column that follows it.

    Rejected are mappings that the keys refuse: a missing new id, an id that is renamed or given twice, a new
    id that the table has already, and an old id that a column refers to which does not follow. ``returned``
    are the mappings that changed a row.
    """
    ids = getattr(t, parent).select(F.col("id").alias("_id"))
    times = lambda column: F.count("*").over(Window.partitionBy(column))
    known = mapping.select("old_id", "new_id").join(ids, F.col("old_id") == F.col("_id"), "left_semi")
    marked = known.withColumn("_twice", (times("old_id") > 1) | (times("new_id") > 1) | F.col("new_id").isNull())
    held = None
    for table, column in _holding(t, parent):
        # a row that refers to itself, such as a manager, holds its own key, too
        refers = getattr(t, table).filter(F.col(column).isNotNull()).select(F.col(column).alias("_held")).distinct()
        held = refers if held is None else held.union(refers)
    taken = marked.join(ids, F.col("new_id") == F.col("_id"), "left_semi").select(F.col("old_id").alias("_bad"))
    bad = taken if held is None else taken.union(held.select(F.col("_held").alias("_bad")))
    fine = marked.filter("not _twice").join(bad.distinct(), F.col("old_id") == F.col("_bad"), "left_anti")
    fine = fine.select("old_id", "new_id")
    rejected = known.join(fine.select(F.col("old_id").alias("_fine")), F.col("old_id") == F.col("_fine"), "left_anti")
    pairs = fine.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))

    def renamed(table: str, column: str) -> DataFrame:
        frame = getattr(t, table)
        return frame.join(pairs, F.col(column) == F.col("_old"), "left").select(
            *[F.coalesce("_new", c).alias(c) if c == column else frame[c] for c in frame.columns]
        )

    tables = {parent: renamed(parent, "id")} | {table: renamed(table, column) for table, column in CASCADES[parent]}
    return Change(tables, fine, rejected)


def split_by_write_access(
    t: Tables, changes: DataFrame, owner: str | None = "employee", email: str = "email"
) -> tuple[DataFrame, DataFrame]:
    """Split changes into allowed and rejected by the acting employee's e-mail: the row is their own, or they
    are an administrator. Without ``owner`` only administrators may write. An unknown e-mail may not."""
    admins = t.employee_role.filter(F.col("role_type") == "admin").select(F.col("employee_id").alias("_actor"))
    actors = t.employees.select(F.col("email").alias("_email"), F.col("id").alias("_actor"))
    actors = actors.join(admins.distinct().withColumn("_admin", F.lit(True)), "_actor", "left")
    allowed = F.coalesce("_admin", F.lit(False))
    if owner is not None:
        allowed = allowed | F.coalesce(F.col(owner) == F.col("_actor"), F.lit(False))
    marked = changes.join(actors, F.col(email) == F.col("_email"), "left").withColumn("_allowed", allowed)
    helpers = ("_email", "_actor", "_admin", "_allowed")
    return marked.filter("_allowed").drop(*helpers), marked.filter(~F.col("_allowed")).drop(*helpers)
