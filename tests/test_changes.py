from __future__ import annotations

import datetime as dt
import re
import random
from decimal import Decimal

import pytest

from shiftledger.operators import changes, contracts
from shiftledger.sources.tables import read_tables, write_snapshot
from tests.conftest import day, in_order, rows_of
from tests.test_plans import plan

RANGE = "seq int, employee int, project string, start_date date, end_date date, percentage int"
HOLIDAY = day("2024-01-10")
PROJECTS = ["P", "Q", "FER1000"]


def staffing_rows(*keys):
    return [{"employee": e, "project": p, "date": day(d), "percentage": n} for e, p, d, n in keys]


@pytest.fixture(scope="module")
def t(make_tables):
    return make_tables(
        employees=[{"id": i, "email": f"{i}@x", "date_of_employment": day("2020-01-01")} for i in (1, 2, 3)],
        projects=[{"id": "P"}, {"id": "Q"}, {"id": "FER1000", "billable": "unavailable"}],
        customers=[{"id": "c", "name": "Customer"}],
        holidays=[{"date": HOLIDAY, "name": "x"}],
        staffing=staffing_rows(
            (1, "P", "2024-01-09", 70), (1, "P", "2024-01-13", 60), (2, "Q", "2024-01-08", 100), (2, "P", "2024-01-10", 100)
        ),
        absence=[{"employee_id": 1, "reason": "FER1000", "date": day("2024-01-08")}],
    )


def requests(spark, *rows):
    return spark.createDataFrame([(i, e, p, day(a), b and day(b), n) for i, (e, p, a, b, n) in enumerate(rows)], RANGE)


def some_requests(seed):
    """A shuffled batch with overlaps, weekends, the holiday, reversed ranges and absence codes."""
    chance = random.Random(seed)
    first = dt.date(2024, 1, 5)
    rows = []
    for _ in range(25):
        start = first + dt.timedelta(days=chance.randrange(14))
        end = start + dt.timedelta(days=chance.randrange(-2, 6))
        rows.append((chance.choice((1, 2)), chance.choice(PROJECTS), str(start), str(end), chance.choice((20, 50, 100))))
    return rows


def days(start, end):
    return [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]


class OneByOne:
    """The requests applied one after the other to plain dictionaries."""

    def __init__(self):
        self.staffing = {(1, "P", day("2024-01-09")): 70, (1, "P", day("2024-01-13")): 60}
        self.staffing |= {(2, "Q", day("2024-01-08")): 100, (2, "P", day("2024-01-10")): 100}
        self.absence = {(1, "FER1000", day("2024-01-08")): 100}
        self.returned, self.rejected = [], []

    def insert(self, table, seq, key, percentage):
        if key not in table:
            table[key] = percentage
            self.returned.append((seq, *key))

    def add_in_period(self, seq, e, p, start, end, n):
        table = self.absence if p == "FER1000" else self.staffing
        for d in days(start, max(start, end)):
            if d.weekday() < 5:
                self.insert(table, seq, (e, p, d), n)

    def remove_in_period(self, seq, e, p, start, end, n):
        table = self.absence if p == "FER1000" else self.staffing
        for d in days(start, end):
            if d.weekday() < 5 and table.pop((e, p, d), None) is not None:
                self.returned.append((seq, e, p, d))

    def insert_range(self, seq, e, p, start, end, n):
        if p == "FER1000":
            self.rejected.append(seq)
            return
        for d in days(start, end):
            if d.weekday() < 5 and d != HOLIDAY:
                self.insert(self.staffing, seq, (e, p, d), n)

    def upsert_range(self, seq, e, p, start, end, n):
        if p != "FER1000":
            for d in days(start, end):
                self.staffing.pop((e, p, d), None)
        self.insert_range(seq, e, p, start, end, n)

    def remove_range(self, seq, e, p, start, end, n):
        for d in sorted(k[2] for k in self.staffing if k[:2] == (e, p) and k[2] >= start and (n == 50 or k[2] <= end)):
            del self.staffing[e, p, d]
            self.returned.append((seq, e, p, d))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    ("operator", "method"),
    [
        (changes.add_staffing_in_period, "add_in_period"),
        (changes.remove_staffing_in_period, "remove_in_period"),
        (changes.insert_staffing, "insert_range"),
        (changes.upsert_staffing, "upsert_range"),
        (changes.remove_staffing, "remove_range"),
    ],
)
def test_a_batch_equals_its_requests_one_by_one(spark, t, operator, method, seed):
    rows = some_requests(seed)
    expected = OneByOne()
    for seq, (e, p, start, end, n) in enumerate(rows):
        getattr(expected, method)(seq, e, p, day(start), day(end), n)
    if method == "remove_range":
        rows = [(e, p, start, None if n == 50 else end, n) for e, p, start, end, n in rows]
    change = operator(t, requests(spark, *rows))
    found = {(r.employee, r.project, r.date): r.percentage for r in change.tables["staffing"].collect()}
    assert found == expected.staffing
    if "absence" in change.tables:
        rows_found = change.tables["absence"].collect()
        assert {(r.employee_id, r.reason, r.date): r.percentage for r in rows_found} == expected.absence
    assert rows_of(change.returned, "seq", "employee", "project", "date") == in_order(expected.returned)
    if change.rejected is not None:
        assert [r[0] for r in rows_of(change.rejected, "seq")] == sorted(expected.rejected)


def test_inserting_twice_is_inserting_once(spark, t):
    batch = requests(spark, (1, "Q", "2024-01-08", "2024-01-12", 50))
    once = changes.insert_staffing(t, batch)
    twice = changes.insert_staffing(t.replace(**once.tables), batch)
    assert rows_of(twice.tables["staffing"]) == rows_of(once.tables["staffing"])
    assert twice.returned.count() == 0


def test_upsert_is_remove_then_insert(spark, t):
    batch = requests(spark, (1, "P", "2024-01-08", "2024-01-14", 50))
    removed = changes.remove_staffing(t, batch)
    inserted = changes.insert_staffing(t.replace(**removed.tables), batch)
    assert rows_of(changes.upsert_staffing(t, batch).tables["staffing"]) == rows_of(inserted.tables["staffing"])


def test_ranges_of_an_upsert_meet_by_month_and_become_days_last(spark, t):
    text = plan(changes.upsert_staffing(t, requests(spark, (1, "P", "2024-01-08", "2024-01-14", 50))).tables["staffing"])
    moved = [line for line in text.splitlines() if "hashpartitioning(employee" in line]
    assert moved and all("_month" in line and "date#" not in line for line in moved)


def test_an_upsert_over_months_keeps_repeats_and_rows_without_key(spark, make_tables):
    keys = [(1, "P", "2023-11-30"), (1, "P", "2023-12-29"), (1, "P", "2024-02-29"), (1, "P", "2024-03-04"), (2, "P", "2023-12-29")]
    plain = make_tables(projects=[{"id": "P"}], holidays=[{"date": day("2024-01-01"), "name": "h"}])
    kind = "employee int, project string, date date, percentage int"
    odd = [(None, "P", day("2023-12-29"), 70), (1, None, day("2023-12-29"), 70), (1, "P", None, 70)]
    stored = spark.createDataFrame([(e, p, day(d), n) for e, p, d in keys for n in (60, 60)] + odd, kind)
    asked = spark.createDataFrame(
        [
            (None, 1, "P", day("2023-12-28"), day("2023-12-28"), 10),
            (0, 1, "P", day("2023-12-28"), day("2024-03-01"), 20),
            (1, 1, "P", day("2023-12-30"), day("2024-02-27"), 30),
            (2, 1, "P", day("2024-02-28"), day("2024-02-27"), 40),
            (3, None, "P", day("2023-12-29"), day("2023-12-29"), 50),
        ],
        "seq int, employee int, project string, start_date date, end_date date, percentage int",
    )
    found = rows_of(changes.upsert_staffing(plain.replace(staffing=stored), asked).tables["staffing"])
    weekdays = [d for d in (dt.date(2023, 12, 28) + dt.timedelta(days=i) for i in range(65)) if d.weekday() < 5 and d != day("2024-01-01")]
    new = [(1, "P", d, 30 if day("2023-12-30") <= d <= day("2024-02-27") else 20) for d in weekdays if d <= day("2024-03-01")]
    kept = [(e, p, day(d), n) for e, p, d in (keys[0], keys[3], keys[4]) for n in (60, 60)]
    assert found == in_order(new + kept + odd + [(None, "P", day("2023-12-29"), 50)])


WEEK = "seq int, employee int, project string, year int, week int, days int"


def test_adding_by_week_takes_the_first_free_days_in_turn(spark, t):
    batch = spark.createDataFrame(
        [(0, 1, "Q", 2024, 2, 1), (1, 1, "P", 2024, 2, 9), (2, 1, "Q", 2024, 2, 1), (3, 2, "Q", 2024, 2, 0)], WEEK
    )
    # Employee 1 is absent on the 8th and staffed on the 9th; the 10th is a holiday.
    found = rows_of(changes.add_staffing_in_week(t, batch).returned)
    assert found == [(0, 1, "Q", day("2024-01-11")), (1, 1, "P", day("2024-01-12"))]


def test_removing_by_week_takes_the_latest_days(spark, t):
    batch = spark.createDataFrame([(0, 1, "P", 2024, 2, 1), (1, 1, "P", 2024, 2, 5), (2, 2, "P", 2024, 3, 1)], WEEK)
    change = changes.remove_staffing_in_week(t, batch)
    assert rows_of(change.returned) == [(0, 1, "P", day("2024-01-13")), (1, 1, "P", day("2024-01-09"))]
    assert change.tables["staffing"].count() == 2


def test_misplaced_staffing_moves_to_free_days(spark, t, make_tables):
    busy = [{"employee_id": 2, "reason": "FER1000", "date": day(f"2024-01-{d:02d}")} for d in (9, 11, 12)]
    change = changes.fix_staffing_on_weekends_and_holidays(t.replace(absence=make_tables(absence=busy).absence))
    # Employee 1's Saturday goes to Monday; employee 2's holiday has no free day left.
    assert rows_of(change.tables["staffing"], "employee", "project", "date", "percentage") == [
        (1, "P", day("2024-01-08"), 100),
        (1, "P", day("2024-01-09"), 70),
        (2, "Q", day("2024-01-08"), 100),
    ]
    assert rows_of(change.returned) == [(2, 2024, 2, 1, "P")]


def test_locks_skip_a_repeated_commit_date(spark, t, make_tables):
    tables = t.replace(
        time_entry=make_tables(
            time_entry=[{"employee": e, "project": "P", "date": day("2024-01-09"), "minutes": 60} for e in (1, 2, 2)]
        ).time_entry,
        timelock_events=make_tables(
            timelock_events=[
                {"employee": 1, "commit_date": day("2024-01-31"), "created": dt.datetime(2024, 1, 1)},
                {"employee": 2, "commit_date": day("2024-01-31"), "created": dt.datetime(2024, 1, 1)},
                {"employee": 2, "commit_date": day("2024-01-15"), "created": dt.datetime(2024, 1, 2)},
            ]
        ).timelock_events,
    )
    schema = "seq int, project string, start_date date, end_date date, commit_date date, creator int"
    lock = ("P", day("2024-01-01"), day("2024-01-31"), day("2024-01-31"), 3)
    later = ("P", day("2024-01-01"), day("2024-01-31"), day("2024-02-29"), 3)
    batch = spark.createDataFrame([(0, *lock), (1, *lock), (2, *later)], schema)
    change = changes.lock_employee_hours(tables, batch, dt.datetime(2024, 3, 1, 8))
    assert rows_of(change.returned, "seq", "employee") == [(0, 2), (2, 1), (2, 2)]
    newest = changes.latest_timelocks(tables.replace(**change.tables))
    assert rows_of(newest.filter("employee = 2"), "created")[0] == (dt.datetime(2024, 3, 1, 8),)
    unset = make_tables(timelock_events=[{"employee": 5, "created": c, "commit_date": day(d)} for c, d in
                                         ((None, "2024-01-01"), (dt.datetime(2024, 5, 1), "2024-02-02"))])
    assert rows_of(changes.latest_timelocks(unset), "commit_date") == [(day("2024-01-01"),)]


def test_locks_meet_entries_by_equality_on_project_and_days(spark, make_tables):
    rng = random.Random(8)
    some = lambda: day("2024-01-01") + dt.timedelta(days=rng.randrange(200))
    worked = [(rng.randrange(9), rng.choice(("P", "Q", "R")), some()) for _ in range(150)]
    t = make_tables(time_entry=[{"employee": e, "project": p, "date": d, "minutes": 60} for e, p, d in worked])
    asked = []
    for i in range(60):
        start = some()
        asked.append((i, rng.choice(("P", "Q", None)), start, start + dt.timedelta(days=rng.randrange(-2, 60)), start, 3))
    asked.append((60, "P", None, day("2024-05-05"), None, 3))
    kinds = "seq int, project string, start_date date, end_date date, commit_date date, creator int"
    batch = spark.createDataFrame(asked + asked[:3], kinds)
    want = [(q[0], e) for q in asked + asked[:3] if q[2] for e in range(9) if any(x == e and p == q[1] and q[2] <= d <= q[3] for x, p, d in worked)]
    met = changes._touched(t, batch)
    assert rows_of(met, "seq", "employee") == in_order(want)
    join = next(line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "(project#" in join and "_stretch#" in join


def test_locks_of_several_blocks_follow_one_another(spark, make_tables, monkeypatch):
    """Requests of a block, of many, with equal and null commit dates; the pairs of a cell are not shuffled."""
    rng = random.Random(3)
    some = lambda: day("2024-01-01") + dt.timedelta(days=rng.randrange(60))
    commits = [day("2024-02-29"), day("2024-03-31"), None]
    worked = {(rng.randrange(12), rng.choice("PQ"), some()) for _ in range(80)}
    known = {e: rng.choice(commits[:2]) for e in range(6)}
    t = make_tables(
        time_entry=[{"employee": e, "project": p, "date": d, "minutes": 60} for e, p, d in worked],
        timelock_events=[{"employee": e, "commit_date": c, "created": dt.datetime(2024, 1, 1)} for e, c in known.items()],
    )
    asked = []
    for i in range(70):
        start = some()
        asked.append((i * i - 900, rng.choice("PQ"), start, start + dt.timedelta(days=rng.randrange(25)), rng.choice(commits), 3))
    want, last = [], {}
    for seq, project, start, end, commit, _ in asked:
        for e in {x for x, p, d in worked if p == project and start <= d <= end}:
            if (last.get(e) or known.get(e)) != commit:
                want.append((seq, e, commit))
            last[e] = commit
    kinds = "seq int, project string, start_date date, end_date date, commit_date date, creator int"
    batch = spark.createDataFrame(rng.sample(asked, 70) + [(None, "P", day("2024-01-01"), day("2024-03-01"), None, 3)], kinds)
    monkeypatch.setattr(changes, "LOCK_BLOCKS", 8)
    for size in (1 << 16, 9):
        monkeypatch.setattr(changes, "LOCK_BLOCK", size)
        change = changes.lock_employee_hours(t, batch, dt.datetime(2024, 3, 1, 8))
        assert in_order(rows_of(change.returned, "seq", "employee", "commit_date")) == in_order(want)
        assert change.tables["timelock_events"].count() == len(want) + len(known)
    lines = plan(changes._touched(t, batch)).splitlines()
    made = next(i for i, line in enumerate(lines) if "Generate explode(_requests" in line)
    laid = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert made < laid and "hashpartitioning(_cell" in lines[laid]
    lines = plan(change.returned).splitlines()
    cells = [line for line in lines if "Exchange" in line and "_cell" in line]
    assert cells and all("REPARTITION_BY_NUM" in line for line in cells)


@pytest.fixture(scope="module")
def invoiced(make_tables):
    end = day("2024-01-31")
    return make_tables(
        invoice_balance=[{"id": "i1", "project": "P", "date": end, "amount": Decimal("5.00"), "minutes": 10, "status": "sent"}],
        expense=[{"id": "e1", "invoice_balance": "i1", "type": k, "amount": Decimal("1.00")} for k in ("other", "subcontractor")],
        write_off=[{"id": "w1", "invoice_balance": "i1", "minutes": 5}, {"id": "w2", "invoice_balance": "i1", "minutes": 6}],
    )


def test_invoice_upserts(spark, invoiced):
    end, today = day("2024-01-31"), day("2024-02-02")
    batch = spark.createDataFrame(
        [(0, "P", end, 1, Decimal("1.00")), (1, "P", end, 2, Decimal("2.00")), (2, "Q", end, 3, Decimal("3.00"))],
        "seq int, project string, date date, minutes int, amount decimal(10,2)",
    )
    change = changes.upsert_invoice_balance(invoiced, batch, today)
    found = rows_of(change.tables["invoice_balance"], "project", "amount", "minutes", "status")
    assert found == [("P", Decimal("2.00"), 2, "sent"), ("Q", Decimal("3.00"), 3, "not_done")]
    assert rows_of(change.returned.filter("project = 'P'"), "seq", "id") == [(0, "i1"), (1, "i1")]
    lacking = spark.createDataFrame([(5, "P", end, None, Decimal("1.00"))], batch.schema)
    refused = changes.upsert_invoice_balance(invoiced, lacking, today)
    assert rows_of(refused.rejected, "seq") == [(5,)] and refused.returned.count() == 0
    assert rows_of(refused.tables["invoice_balance"], "minutes") == rows_of(invoiced.invoice_balance, "minutes")
    status = spark.createDataFrame([(0, "P", end, "ok"), (1, "R", end, "ok")], "seq int, project string, date date, status string")
    changed = changes.upsert_invoice_status(invoiced, status, today).tables["invoice_balance"]
    assert rows_of(changed, "project", "amount", "status") == [("P", Decimal("5.00"), "ok"), ("R", Decimal("0.00"), "ok")]


def test_expenses_and_write_offs_are_replaced(spark, invoiced):
    end, today = day("2024-01-31"), day("2024-02-02")
    expense = spark.createDataFrame(
        [(0, "P", end, "other", Decimal("9.00")), (1, "Q", end, "other", Decimal("8.00"))],
        "seq int, project string, date date, type string, amount decimal(10,2)",
    )
    expense = expense.union(spark.createDataFrame([(2, "P", end, "other", Decimal("9.00"))], expense.schema))
    change = changes.upsert_expense(invoiced, expense, today)
    reported = {r.seq: r.id for r in change.returned.collect()}
    assert set(reported) == {0, 1, 2} and reported[0] == reported[2]
    assert set(reported.values()) <= {r.id for r in change.tables["expense"].collect()}
    kept = rows_of(change.tables["expense"].filter("invoice_balance = 'i1'"), "type", "amount")
    assert kept == [("other", Decimal("9.00")), ("subcontractor", Decimal("1.00"))]
    assert change.tables["invoice_balance"].count() == 2
    write_off = spark.createDataFrame([(0, "P", end, 7)], "seq int, project string, date date, minutes int")
    assert rows_of(changes.upsert_write_off(invoiced, write_off, today).tables["write_off"], "minutes") == [(7,)]


def test_moving_absence_out_of_staffing(spark, t, make_tables):
    tables = t.replace(
        staffing=make_tables(
            staffing=staffing_rows(
                (1, "FER1000", "2024-01-08", 40), (1, "FER1000", "2024-01-10", 50), (2, "AVS", "2024-01-09", 60), (2, "P", "2024-01-09", 80)
            )
        ).staffing
    )
    moved = changes.move_absence_out_of_staffing(tables)
    assert rows_of(moved.tables["staffing"], "project") == [("P",)]
    assert rows_of(moved.tables["absence"], "employee_id", "date", "percentage") == [
        (1, day("2024-01-08"), 100), (1, day("2024-01-10"), 50), (2, day("2024-01-09"), 60)
    ]
    first = changes.move_absence_out_of_staffing(tables, skip_holidays=True)
    assert rows_of(first.returned, "project", "date") == [("AVS", day("2024-01-09"))]
    assert first.tables["staffing"].count() == 1


def test_renamed_keys_reach_the_children(spark, t):
    mapping = spark.createDataFrame([("P", "Pæøå")], "old_id string, new_id string")
    renamed = changes.rename_keys(t, "projects", mapping).tables
    assert ("Pæøå",) in rows_of(renamed["projects"], "id")
    assert {r.project for r in renamed["staffing"].collect()} == {"Pæøå", "Q"}
    people = changes.rename_keys(t, "employees", spark.createDataFrame([(1, 11)], "old_id int, new_id int"))
    held = {r.employee for r in t.time_entry.collect()} | {r.employee_id for r in t.absence.collect()}
    assert {r.employee for r in people.tables["staffing"].collect()} == ({1, 2} if 1 in held else {11, 2})
    assert people.rejected.count() == (1 in held)


def test_renames_that_the_keys_refuse(spark, make_tables):
    tables = make_tables(
        employees=[{"id": i} for i in range(1, 7)],
        customers=[{"id": "c", "name": "C"}],
        projects=[{"id": "P", "responsible": 1}, {"id": "Q"}, {"id": "R"}],
        time_entry=[{"employee": 2, "creator": 3, "project": "P", "date": day("2024-01-08")}],
        invoice_balance=[{"id": "i", "project": "Q", "date": day("2024-01-31")}],
    )
    pairs = lambda rows, kind: spark.createDataFrame(rows, f"old_id {kind}, new_id {kind}")
    people = changes.rename_keys(tables, "employees", pairs([(1, 11), (2, 12), (3, 13), (4, 5), (5, 15), (5, 16), (6, None), (9, 19)], "int"))
    assert rows_of(people.returned) == [(1, 11)]
    assert rows_of(people.rejected, "old_id", "new_id") == in_order([(2, 12), (3, 13), (4, 5), (5, 15), (5, 16), (6, None)])
    assert ("P", 11) in rows_of(people.tables["projects"].select("id", "responsible"))
    projects = changes.rename_keys(tables, "projects", pairs([("P", "X"), ("Q", "Y"), ("R", "P")], "string"))
    assert rows_of(projects.returned) == [("P", "X")]
    assert rows_of(projects.tables["time_entry"], "project") == [("X",)]
    customers = changes.rename_keys(tables, "customers", pairs([("c", "d")], "string"))
    assert rows_of(customers.returned) == [("c", "d")] and {r.customer for r in customers.tables["projects"].collect()} == {"d"}


def test_write_access(spark, t, make_tables):
    tables = t.replace(employee_role=make_tables(employee_role=[{"employee_id": 3, "role_type": "admin"}]).employee_role)
    edits = spark.createDataFrame([(1, "1@x"), (1, "2@x"), (1, "3@x"), (1, "nobody@x"), (1, None)], "employee int, email string")
    allowed, rejected = changes.split_by_write_access(tables, edits)
    assert rows_of(allowed, "email") == [("1@x",), ("3@x",)]
    assert rejected.count() == 3
    only_admins, _ = changes.split_by_write_access(tables, edits, owner=None)
    assert rows_of(only_admins, "email") == [("3@x",)]


def test_valid_tables_have_no_violations(t):
    assert contracts.contract_report(t).count() == 0


def test_violations_are_named(spark, make_tables):
    t = make_tables(
        employees=[{"id": 1, "email": "a", "emoji": "ab"}, {"id": 2, "email": "a", "gender": "x", "hr_manager": 7}],
        customers=[{"id": "c", "name": "C", "tripletex_number": 5}, {"id": "d", "name": "D", "tripletex_number": 5}],
        projects=[{"id": "P", "customer": "gone"}],
        absence=[{"employee_id": 1, "reason": "P", "date": HOLIDAY}],
        holidays=[{"date": HOLIDAY, "name": "x"}],
        ranked_games=[{"id": "g"}],
        ranked_matchups=[{"id": "m", "game_id": "g", "user1_id": 1, "user2_id": 1, "matchup_result": "DRAW"}],
    )
    assert rows_of(contracts.contract_report(t)) == in_order([
        ("absence", "check: absence reason", "1|P|2024-01-10"),
        ("absence", "check: not on a holiday", "1|P|2024-01-10"),
        ("customers", "unique: tripletex_number", "5"),
        ("employees", "allowed values: gender", "2"),
        ("employees", "check: emoji", "1"),
        ("employees", "foreign key: hr_manager", "7"),
        ("employees", "unique: email", "a"),
        ("projects", "foreign key: customer", "gone"),
        ("ranked_matchups", "allowed values: matchup_result", "m"),
        ("ranked_matchups", "check: two players", "m"),
    ])


def test_missing_values_are_reported(spark, t):
    loose = spark.createDataFrame([("x", None)], "id string, name string")
    found = rows_of(contracts.table_violations(t.replace(customers=loose), "customers"))
    assert found == [("customers", "not null: name", "x")]


def test_a_snapshot_can_be_written_and_read(spark, t, tmp_path):
    write_snapshot(t.staffing, f"{tmp_path}/staffing", ("date", "employee"))
    stored = read_tables(spark, str(tmp_path))
    assert rows_of(stored.staffing) == rows_of(t.staffing)
    with pytest.raises(Exception, match="already exists"):
        write_snapshot(t.staffing, f"{tmp_path}/staffing")


def test_a_report_scans_each_table_once_and_groups_once(spark, make_tables, tmp_path):
    t = make_tables(employees=[{"id": 1}], projects=[{"id": "P", "customer": "c"}], customers=[{"id": "c"}])
    for name in contracts.PRIMARY_KEYS:
        write_snapshot(getattr(t, name), f"{tmp_path}/{name}")
    stored = read_tables(spark, str(tmp_path))
    report = contracts.contract_report(stored)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        text = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    files = "\n".join(line for line in text.splitlines() if "FileScan" in line)
    scans = {name: len(re.findall(rf"{tmp_path}/{name}\]", files)) for name in contracts.PRIMARY_KEYS}
    assert len(scans) == 31 and {n for n, k in scans.items() if k != 1} == {"holidays"} and scans["holidays"] == 2
    assert len(re.findall(r"HashAggregate\(keys=\[space", text)) == 2 and report.count() == 0  # partial and final


def test_repeated_rows_odd_keys_and_parents_outside_the_report(spark, make_tables):
    t = make_tables(
        customers=[{"id": "c"}],
        projects=[{"id": "P", "customer": "gone"}, {"id": "P", "customer": "gone"}, {"id": "Q", "customer": "c"}],
        time_entry_comments=[
            {"id": "a", "employee": 1, "project": p, "date": HOLIDAY} for p in ("x|2024-01-10", "x", "x")
        ],
        employees=[{"id": 1, "gender": "y"}, {"id": 1, "gender": "z"}],
    )
    found = rows_of(contracts.contract_report(t, ("projects", "time_entry_comments", "employees")))
    assert found == in_order([
        ("employees", "allowed values: gender", "1"), ("employees", "allowed values: gender", "1"),
        ("employees", "primary key: id", "1"), ("employees", "unique: email", ""),
        ("projects", "foreign key: customer", "gone"), ("projects", "primary key: id", "P"),
        ("time_entry_comments", "foreign key: creator", "0"),
        ("time_entry_comments", "foreign key: project", "x"), ("time_entry_comments", "foreign key: project", "x|2024-01-10"),
        ("time_entry_comments", "primary key: id", "a"),
        ("time_entry_comments", "unique: employee, project, date", "1|x|2024-01-10"),
    ])
