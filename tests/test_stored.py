from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from shiftledger import Periods
from shiftledger.operators import capacity, changes, entries, kpi
from shiftledger.plans.rollup import entry_rollup, read_rollup
from shiftledger.sources.months import (
    apply_change,
    apply_staged,
    changed_months,
    refresh_rollup,
    stage_change,
    store_rollup,
    write_months,
)
from tests.conftest import day, in_order, rows_of
from tests.test_plans import plan


def files(path: str) -> dict[str, float]:
    """Data files below a folder and when they were written."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                full = os.path.join(folder, name)
                found[os.path.relpath(full, path)] = os.stat(full).st_mtime_ns
    return found


def month_of_file(name: str) -> str:
    return name.split("/")[0].removeprefix("month=")


# Changes of stored tables


@pytest.fixture
def planned(make_tables, tmp_path):
    """Tables whose staffing is stored by month, a day of each month of 2024."""
    staffing = [{"employee": e, "project": "P", "date": dt.date(2024, m, 10), "percentage": 50} for m in range(1, 13) for e in (1, 2)]
    t = make_tables(projects=[{"id": "P"}], employees=[{"id": 1}, {"id": 2}], staffing=staffing)
    folder = str(tmp_path / "tables")
    write_months(t.staffing, f"{folder}/staffing")
    return t.replace(staffing=t.spark.read.parquet(f"{folder}/staffing")), folder


def requests(spark, *rows):
    kinds = "seq int, employee int, project string, start_date date, end_date date, percentage int"
    return spark.createDataFrame([(i, 1, "P", day(a), day(b), p) for i, (a, b, p) in enumerate(rows)], kinds)


def test_only_touched_months_are_written_and_a_second_run_writes_nothing(spark, planned):
    t, folder = planned
    before = files(f"{folder}/staffing")
    asked = requests(spark, ("2024-03-04", "2024-03-06", 80), ("2024-05-30", "2024-06-03", 70))
    wanted = rows_of(changes.upsert_staffing(t, asked).tables["staffing"])
    applied = apply_change(changes.upsert_staffing(t, asked), folder)
    after = files(f"{folder}/staffing")
    assert set(applied.months["staffing"]) == {202403, 202405, 202406}
    kept = {n for n in before if month_of_file(n) not in ("202403", "202405", "202406")}
    assert len(kept) >= 9 and all(after[n] == before[n] for n in kept)
    assert {month_of_file(n) for n in after.keys() - before.keys()} == {"202403", "202405", "202406"}
    assert rows_of(applied.returned, "seq", "date") == [
        (0, day("2024-03-04")), (0, day("2024-03-05")), (0, day("2024-03-06")),
        (1, day("2024-05-30")), (1, day("2024-05-31")), (1, day("2024-06-03")),
    ]
    stored = t.replace(staffing=spark.read.parquet(f"{folder}/staffing"))
    assert rows_of(stored.staffing.drop("month")) == wanted
    again = apply_change(changes.upsert_staffing(stored, asked), folder)
    assert again.months == {"staffing": {}} and files(f"{folder}/staffing") == after
    assert rows_of(again.returned) == rows_of(applied.returned)


def test_a_month_that_becomes_empty_goes(spark, planned):
    t, folder = planned
    everyone = requests(spark, ("2024-04-01", "2024-04-30", 0)).drop("percentage")
    both = everyone.unionByName(everyone.withColumn("employee", F.lit(2)).withColumn("seq", F.lit(1)))
    applied = apply_change(changes.remove_staffing(t, both), folder)
    assert applied.months == {"staffing": {202404: 0}}
    assert not any(month_of_file(n) == "202404" for n in files(f"{folder}/staffing"))
    assert spark.read.parquet(f"{folder}/staffing").count() == 22


def test_a_staged_batch_can_be_put_in_place_again(spark, planned):
    t, folder = planned
    asked = requests(spark, ("2024-03-04", "2024-03-06", 80))
    staged = stage_change(changes.upsert_staffing(t, asked), folder)
    assert rows_of(t.staffing) == rows_of(spark.read.parquet(f"{folder}/staffing"))  # nothing changed yet
    apply_staged(spark, folder, staged.stage)
    once = rows_of(spark.read.parquet(f"{folder}/staffing"))
    apply_staged(spark, folder, staged.stage)
    assert rows_of(spark.read.parquet(f"{folder}/staffing")) == once and len(once) == 27


def test_two_tables_of_a_batch_are_read_before_either_changes(spark, make_tables, tmp_path):
    days = [dt.date(2024, m, d) for m in (1, 2) for d in (8, 9)]
    t = make_tables(
        projects=[{"id": "FER1000", "billable": "unavailable"}, {"id": "P"}],
        staffing=[{"employee": 1, "project": p, "date": d} for d in days for p in ("FER1000", "P")],
        absence=[{"employee_id": 2, "reason": "FER1000", "date": dt.date(2024, 3, 8)}],
    )
    folder = str(tmp_path / "both")
    for name in ("staffing", "absence"):
        write_months(getattr(t, name), f"{folder}/{name}")
    stored = t.replace(**{n: spark.read.parquet(f"{folder}/{n}") for n in ("staffing", "absence")})
    change = changes.move_absence_out_of_staffing(stored)
    want = {name: rows_of(changes.move_absence_out_of_staffing(t).tables[name]) for name in change.tables}
    apply_change(change, folder)
    for name, rows in want.items():
        columns = change.tables[name].columns
        assert rows_of(spark.read.parquet(f"{folder}/{name}").select(*columns)) == rows


def test_versions_that_differ_in_repeats_only_are_told_apart(spark):
    old = spark.createDataFrame([(202401, 1), (202402, 2), (202403, None)], "month int, v int")
    new = old.unionByName(old.filter("month = 202402")).filter("month <> 202403")
    assert changed_months(old, new) == {202402: 2, 202403: 0}
    assert changed_months(old, old) == {}


# The daily roll-up


@pytest.fixture(scope="module")
def ledger(make_tables):
    rng = random.Random(7)
    projects = [("B", "billable"), ("N", "nonbillable"), ("FER1000", "unavailable"), ("SYK1000", "unavailable"), ("FAG1000", "nonbillable")]
    entry = [
        {
            "employee": rng.randrange(1, 6),
            "project": rng.choice(["B", "B", "N", "FER1000", "SYK1000", "FAG1000", "LOST"]),
            "date": dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(120)),
            "minutes": rng.choice((None, 60, 450)),
            "created": rng.choice((None, dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 2, 3))) if i % 9 == 0 else dt.datetime(2024, 5, 1),
        }
        for i in range(500)
    ]
    return make_tables(
        employees=[{"id": i, "date_of_employment": day("2023-01-01")} for i in range(1, 7)],
        projects=[{"id": p, "billable": b, "deductable": p == "FAG1000"} for p, b in projects],
        time_entry=entry,
        staffing=[{"employee": 1, "project": "B", "date": day("2024-02-06")}],
    )


REPORTS = {
    "status": entries.time_tracking_status,
    "status with staffing": entries.time_tracking_status_with_staffing,
    "billed": entries.billable_hours_for_employees,
    "unregistered": entries.unregistered_days,
    "distribution": entries.time_distribution,
    "sick": entries.sick_hours,
    "development": entries.product_development_hours,
    "bonus": entries.bonus_hours_for_employees,
    "totals": capacity.accumulated_billed_hours,
    "fg": lambda t, p: kpi.fg(t, p, safe=True),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_are_the_same_from_the_rollup(spark, ledger, name):
    rolled = ledger.replace(entry_rollup=entry_rollup(ledger))
    for periods in (
        Periods.month_windows(spark, day("2024-02-01"), day("2024-05-01"), 1),
        Periods.month_windows(spark, day("2024-02-01"), day("2024-05-01"), 3),
    ):
        assert rows_of(REPORTS[name](rolled, periods)) == rows_of(REPORTS[name](ledger, periods))


def test_reports_read_the_stored_rollup_alone(spark, ledger, tmp_path):
    folder = str(tmp_path)
    store_rollup(ledger, f"{folder}/rollup")
    ledger.time_entry.write.parquet(f"{folder}/raw_entries")
    rolled = read_rollup(ledger.replace(time_entry=spark.read.parquet(f"{folder}/raw_entries")), f"{folder}/rollup")
    windows = Periods.month_windows(spark, day("2024-03-01"), day("2024-03-01"), 1)
    for report in (entries.time_tracking_status_with_staffing(rolled, windows), kpi.fg(rolled, windows, safe=True)):
        text = plan(report)
        assert "raw_entries" not in text and f"{folder}/rollup" in text
        assert "PartitionFilters: [isnotnull(month" in text and "202402" in text


def test_refreshing_writes_changed_months_only(spark, ledger, tmp_path):
    path = str(tmp_path / "rollup")
    gone = F.month("date") == 3
    before = ledger.replace(time_entry=ledger.time_entry.filter(~gone & ~((F.month("date") == 2) & (F.dayofmonth("date") > 9))))
    store_rollup(before, path)
    old = files(path)
    refresh_rollup(ledger, path, [202402, 202403])
    new = files(path)
    assert {n for n in old if month_of_file(n) in ("202401", "202404")} <= {n for n in new if new[n] == old.get(n)}
    columns = [c for c in entry_rollup(ledger).columns]
    assert rows_of(spark.read.parquet(path), *columns) == rows_of(entry_rollup(ledger), *columns)
    refresh_rollup(before, path, [202403])  # the entries of a whole month went
    assert not any(month_of_file(n) == "202403" for n in files(path))


# The view of time locks


def test_a_view_kept_over_batches_equals_the_full_one(spark, make_tables):
    rng = random.Random(5)
    times = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)]
    events = [
        {"id": f"e{i:03}", "employee": rng.randrange(8), "creator": 1, "created": rng.choice(times[rng.randrange(4) > 0 :]), "commit_date": day("2024-01-05")}
        for i in range(120)
    ]
    t = make_tables(timelock_events=events)
    want = rows_of(changes.latest_timelocks(t))
    for cuts in ((40, 80), (0, 119), (60, 60)):
        batches = [events[: cuts[0]], events[cuts[0] : cuts[1]], events[cuts[1] :]]
        view = make_tables().timelock_events
        for batch in batches + batches[:1]:  # late and repeated events, too
            view = changes.merged_timelocks(view, make_tables(timelock_events=batch).timelock_events)
        assert rows_of(view) == want
    assert in_order(want) == want and len(want) == 8
