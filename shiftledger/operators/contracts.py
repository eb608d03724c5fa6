"""Table contracts as a report: one row per violation, none on valid tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.codes import is_absence_reason, is_emoji
from shiftledger.schemas import SCHEMAS
from shiftledger.sources.tables import Tables

# Keys, references and allowed values of the data contract.
PRIMARY_KEYS = {
    "employees": ("id",),
    "customers": ("id",),
    "projects": ("id",),
    "time_entry": ("id",),
    "staffing": ("employee", "project", "date"),
    "absence": ("employee_id", "reason", "date"),
    "holidays": ("date",),
    "paid_overtime": ("id",),
    "vacation_days": ("employee_id", "year"),
    "invoice_balance": ("id",),
    "expense": ("id",),
    "write_off": ("id",),
    "timelock_events": ("id",),
    "employee_role": ("id",),
    "employee_tenure_role": ("id",),
    "reporting_visibility": ("year", "week"),
    "talks": ("id",),
    "project_sdg_events": ("event_id",),
    "time_entry_comments": ("id",),
    "invoice_lock_events": ("id",),
    "ranked_games": ("id",),
    "ranked_matchups": ("id",),
    "employee_settings": ("employee_id",),
    "employee_task": ("id",),
    "employee_task_comments": ("id",),
    "notification": ("id",),
    "phase": ("id",),
    "process_template": ("slug",),
    "profession": ("slug",),
    "profession_task": ("profession_id", "task_id"),
    "task": ("id",),
}
UNIQUE_KEYS = {
    "employees": (("email",),),
    "customers": (("name",), ("tripletex_number",)),
    "invoice_balance": (("project", "date"), ("invoicenumber",)),
    "time_entry_comments": (("employee", "project", "date"),),
    "profession": (("title",),),
}
FOREIGN_KEYS = {
    "employees": {"employees": ("hr_manager",), "profession": ("profession_id",)},
    "projects": {"customers": ("customer",), "employees": ("responsible",)},
    "time_entry": {"employees": ("employee", "creator"), "projects": ("project",)},
    "staffing": {"employees": ("employee",), "projects": ("project",)},
    "absence": {"employees": ("employee_id",)},
    "paid_overtime": {"employees": ("employee",)},
    "vacation_days": {"employees": ("employee_id",)},
    "invoice_balance": {"projects": ("project",)},
    "expense": {"invoice_balance": ("invoice_balance",)},
    "write_off": {"invoice_balance": ("invoice_balance",)},
    "timelock_events": {"employees": ("creator", "employee")},
    "employee_role": {"employees": ("employee_id",)},
    "employee_tenure_role": {"employees": ("employee_id",)},
    "talks": {"employees": ("employee",)},
    "project_sdg_events": {"employees": ("caused_by",), "projects": ("project",)},
    "time_entry_comments": {"employees": ("employee", "creator"), "projects": ("project",)},
    "invoice_lock_events": {"projects": ("project_id",), "employees": ("creator_id",)},
    "ranked_matchups": {"ranked_games": ("game_id",), "employees": ("user1_id", "user2_id")},
    "employee_settings": {"employees": ("employee_id",)},
    "employee_task": {"employees": ("employee_id", "responsible_id", "completed_by_id"), "task": ("task_id",)},
    "employee_task_comments": {"employees": ("created_by_id",), "employee_task": ("employee_task_id",)},
    "notification": {"employees": ("employee_id", "created_by")},
    "phase": {"process_template": ("process_template_id",)},
    "profession_task": {"profession": ("profession_id",), "task": ("task_id",)},
    "task": {"phase": ("phase_id",), "employees": ("responsible_id",)},
}
ALLOWED_VALUES = {
    ("employees", "gender"): ("male", "female", "other"),
    ("projects", "billable"): ("billable", "nonbillable", "unavailable"),
    ("invoice_balance", "status"): ("not_done", "not_ok", "ok", "sent"),
    ("expense", "type"): ("subcontractor", "other"),
    ("employee_role", "role_type"): ("admin",),
    ("ranked_matchups", "matchup_result"): ("WIN", "LOSS", "TIE"),
    ("task", "responsible_type"): ("HR_MANAGER", "PROJECT_MANAGER", "OTHER"),
}


def _row_checks(table: str) -> dict[str, Column]:
    """Conditions that break a rule visible in the row alone."""
    broken = {}
    for column in (part.strip().split() for part in SCHEMAS[table].replace("(10,2)", "").split(",")):
        if column[2:] == ["NOT", "NULL"]:
            broken[f"not null: {column[0]}"] = F.col(column[0]).isNull()
    for (owner, column), values in ALLOWED_VALUES.items():
        if owner == table:
            broken[f"allowed values: {column}"] = ~F.col(column).isin(*values)
    if table == "absence":
        broken["check: absence reason"] = ~is_absence_reason(F.col("reason"))
    if table == "ranked_matchups":
        broken["check: two players"] = F.col("user1_id") == F.col("user2_id")
    if table == "employees":
        broken["check: emoji"] = ~is_emoji(F.col("emoji"))
    return broken


# Roles of a fact: a broken row, a holder of a key, a reference to a key, a holder that is only looked up.
_BROKEN, _HOLDER, _REFERENCE, _PARENT = range(4)


def _text(columns: tuple[str, ...]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _space(table: str, key: tuple[str, ...]) -> str:
    return f"{table}({','.join(key)})"


class _Plan:
    """What the report looks for, by the space of keys that it is found in: one bit for each reference into a space."""

    def __init__(self, t: Tables, names: tuple[str, ...]):
        self.keys: dict[str, tuple[str, str]] = {}
        self.references: dict[str, list[tuple[str, str]]] = {}
        self.held: dict[str, list[tuple[str, ...]]] = {name: [] for name in names}
        self.referring: dict[str, list[tuple[str, str, int]]] = {name: [] for name in names}
        self.parents: dict[str, tuple[str, ...]] = {}
        for name in names:
            columns = set(getattr(t, name).columns)
            for kind, keys in [("primary key", (PRIMARY_KEYS[name],)), ("unique", UNIQUE_KEYS.get(name, ()))]:
                for key in keys:
                    if columns.issuperset(key):
                        self.held[name].append(key)
                        self.keys[_space(name, key)] = (name, f"{kind}: {', '.join(key)}")
            for parent, references in FOREIGN_KEYS.get(name, {}).items():
                key = PRIMARY_KEYS[parent][:1]
                if parent not in t:
                    continue
                for column in (c for c in references if c in columns):
                    into = self.references.setdefault(_space(parent, key), [])
                    self.referring[name].append((column, _space(parent, key), len(into)))
                    into.append((name, f"foreign key: {column}"))
                    if parent not in names:
                        self.parents[parent] = key


def _fact(condition: Column, space: str, key: Column, role: int, number: int = 0) -> Column:
    fields = (F.lit(space).alias("space"), key.alias("key"), F.lit(role).alias("role"), F.lit(number).alias("number"))
    return F.when(condition, F.struct(*fields))


def _all_known(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _facts(t: Tables, table: str, plan: _Plan) -> DataFrame:
    """All that the report needs of a table, from one scan of it: an array of facts for each row, one below the other."""
    frame = getattr(t, table)
    columns = set(frame.columns)
    key = F.concat_ws("|", _text(PRIMARY_KEYS[table]))
    rules = {r: b for r, b in _row_checks(table).items() if r.startswith("check: ") or r.split(": ")[1] in columns}
    if table == "absence" and "holidays" in t:
        days = t.holidays.select("date", F.lit(True).alias("_holiday")).distinct()
        frame = frame.join(days, "date", "left")
        rules["check: not on a holiday"] = F.col("_holiday")
    # broken rows are few, and each is a violation of its own even where the key is repeated
    rows = frame.withColumn("_row", F.monotonically_increasing_id().cast("string"))
    facts = [_fact(broken, f"{table}: {rule}", F.array(key, "_row"), _BROKEN) for rule, broken in rules.items()]
    facts += [_fact(_all_known(held), _space(table, held), _text(held), _HOLDER) for held in plan.held[table]]
    facts += [
        _fact(F.col(column).isNotNull(), space, _text((column,)), _REFERENCE, number)
        for column, space, number in plan.referring[table]
    ]
    return rows.select(F.inline(F.array_compact(F.array(*facts))))


def _report(t: Tables, names: tuple[str, ...]) -> DataFrame:
    plan = _Plan(t, names)
    facts = [_facts(t, name, plan) for name in names]
    for parent, key in plan.parents.items():
        held = F.array(_fact(_all_known(key), _space(parent, key), _text(key), _PARENT))
        facts.append(getattr(t, parent).select(F.inline(F.array_compact(held))))
    role = F.col("role")
    grouped = reduce(DataFrame.unionByName, facts).groupBy("space", "key").agg(
        F.count(F.when(role == _BROKEN, 1)).alias("broken"),
        F.count(F.when(role == _HOLDER, 1)).alias("holders"),
        F.count(F.when(role == _PARENT, 1)).alias("parents"),
        F.bit_or(F.when(role == _REFERENCE, F.expr("shiftleft(1L, number)"))).alias("references"),
    )
    kind = "array<struct<table: string, rule: string, key: string>>"
    none = F.array().cast(kind)

    def entry(name: Column, rule: Column, key: Column) -> Column:
        return F.struct(name.alias("table"), rule.alias("rule"), key.alias("key"))

    def named(pairs: dict[str, Column]) -> Column:
        known = [x for space, value in pairs.items() for x in (F.lit(space), value)]
        return F.element_at(F.create_map(*known), F.col("space")) if known else F.lit(None)

    shown = F.concat_ws("|", "key")
    pair = lambda x: F.struct(F.lit(x[0]).alias("table"), F.lit(x[1]).alias("rule"))
    rows = F.array(entry(F.substring_index("space", ": ", 1), F.expr("substring(space, instr(space, ': ') + 2)"), F.col("key")[0]))
    violations = F.when(F.col("broken") > 0, rows)
    if plan.keys:
        owner = named({space: pair(x) for space, x in plan.keys.items()})
        repeated = F.array(entry(owner["table"], owner["rule"], shown))
        violations = violations.when(F.col("holders") > 1, repeated)
    if plan.references:
        numbered = [
            F.array(*[F.struct(pair(x).alias("of"), F.lit(1 << i).cast("long").alias("bit")) for i, x in enumerate(into)])
            for into in plan.references.values()
        ]
        into = named(dict(zip(plan.references, numbered, strict=True)))
        held = F.filter(into, lambda x: F.col("references").bitwiseAND(x["bit"]) != 0)
        orphans = F.transform(held, lambda x: entry(x["of"]["table"], x["of"]["rule"], F.col("key")[0]))
        unknown = (F.col("holders") + F.col("parents") == 0) & F.col("references").isNotNull()
        violations = violations.when(unknown, orphans)
    return grouped.select(F.inline(violations.otherwise(none).cast(kind)))


def table_violations(t: Tables, table: str) -> DataFrame:
    """All violations in one table, see ``contract_report``."""
    return _report(t, (table,))


def contract_report(t: Tables, tables: tuple[str, ...] | None = None) -> DataFrame:
    """(table, rule, key) of every violation in the given tables, by default in all that are present.

    ``key`` is the primary key of the offending row; for a duplicate it is the repeated key, for a broken reference the
    value that has no parent. Every table is scanned once (holidays, which absence looks up, twice): a row gives what it
    breaks, the keys it holds and those it refers to, and one grouped pass over all tables counts holders and notes, in
    a bit each, which references meet a key. Facts combine inside each task, so a value that many rows hold is shuffled
    once for each.
    """
    names = tables if tables is not None else tuple(name for name in SCHEMAS if name in t)
    return _report(t, tuple(names))
