from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from shiftledger import Periods
from shiftledger.operators import capacity, entries, kpi
from shiftledger.sources.tables import read_tables, write_snapshot
from tests.conftest import day

SMALL = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, make_tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    t = make_tables(
        employees=[{"id": 1, "date_of_employment": day("2020-01-01")}],
        projects=[{"id": "B"}],
        time_entry=[{"employee": 1, "project": "B", "date": day("2024-01-08"), "minutes": 60}],
    )
    for name in ("employees", "projects", "time_entry", "staffing", "absence", "holidays"):
        write_snapshot(getattr(t, name), f"{folder}/{name}")
    return read_tables(spark, folder)


def test_period_bounds_and_columns_reach_the_scan(spark, stored):
    text = plan(kpi.fg(stored, Periods.single(spark, day("2024-01-01"), day("2024-01-31"))))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "minutes" in line)
    assert "GreaterThanOrEqual(date,2024-01-01)" in scan and "LessThanOrEqual(date,2024-01-31)" in scan
    assert "ReadSchema: struct<minutes:int,project:string,date:date>" in scan


@pytest.mark.parametrize("operator", [entries.time_tracking_status_with_staffing, kpi.fg, kpi.hours_per_project, kpi.ot])
def test_no_nested_loops_and_no_python(spark, make_tables, operator):
    text = plan(operator(make_tables(), Periods.month_windows(spark, day("2024-01-01"), day("2024-12-01"), 1)))
    assert not any(word in text for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))


@pytest.mark.parametrize("operator", [entries.time_tracking_status, capacity.availability_percentage, kpi.hours_per_project, capacity.accumulated_billed_hours])
def test_period_tables_meet_rows_without_nested_loops(spark, make_tables, operator):
    ranges = spark.createDataFrame([(day("2024-01-01"), day("2024-01-31"))], "from_date date, to_date date")
    text = plan(operator(make_tables(), Periods.from_table(ranges)))
    assert not any(word in text for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"))


def test_unknown_or_large_periods_are_not_broadcast(spark):
    ranges = spark.createDataFrame([(day("2024-01-01"), day("2024-01-31"))], "from_date date, to_date date")
    facts = spark.range(10).selectExpr("date_add(date '2024-01-01', cast(id as int)) as date")
    assert "SortMergeJoin" in plan(Periods.from_table(ranges).days().join(facts, "date"))
    long = Periods.month_windows(spark, day("1500-01-01"), day("2024-12-01"), 6)
    assert "SortMergeJoin" in plan(long.days().join(facts, "date"))
    assert "BroadcastHashJoin" in plan(Periods.weeks(spark, day("1980-01-01"), day("2024-12-01")).days().join(facts, "date"))


def test_facts_are_folded_before_a_shuffle_by_date(spark):
    """Where the days of the periods are joined by a shuffle, rows reach it as one per key and day."""
    facts = spark.range(1000).selectExpr("id % 7 AS employee", "date_add(date '2024-01-01', cast(id % 5 AS int)) AS date", "id AS minutes")
    text = plan(Periods.weeks(spark, day("1100-01-01"), day("5000-01-01")).sum_by(facts, "employee", minutes=F.col("minutes")))
    join = text.index("SortMergeJoin")
    assert "hashpartitioning(employee" in text[join:] and "HashAggregate(keys=[employee" in text[join:]


def test_days_of_entries_are_not_copied_for_each_period(spark, make_tables):
    """Minutes of a project reach its periods inside its own row: no aggregation by project and period over them."""
    text = plan(kpi.hours_per_project(make_tables(), Periods.month_windows(spark, day("2024-01-01"), day("2024-12-01"), 12)))
    assert not any("HashAggregate(keys=[from_date" in line and "sum(minutes" in line for line in text.splitlines())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["c12_time_tracking_status_with_staffing", "e19_hours_per_project", "g4_upsert_staffing"])
def test_queries_equal_their_twins(spark, name):
    from crosscheck.compare import compare

    assert compare(spark, name, SMALL) == ""
