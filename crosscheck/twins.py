"""DuckDB statements that must give what the queries give. Each is worked out anew from the meaning of the
operator, mostly as brute-force joins with a day calendar, so that it shares no plan with the library."""

from __future__ import annotations

import re

START, END = "DATE '1995-02-01'", "DATE '2001-12-01'"
YEAR_FIRST, YEAR_LAST = "DATE '1998-01-01'", "DATE '1998-12-31'"
WHOLE_FIRST, WHOLE_LAST = "DATE '1995-01-01'", "DATE '2001-11-30'"
HIRED_FIRST, HIRED_LAST = "DATE '1997-01-06'", "DATE '2001-11-20'"
MIXED_FIRST, MIXED_LAST = "DATE '1995-01-01'", "DATE '2001-11-20'"
AS_OF, LAST_DAY = "DATE '1998-06-15'", "DATE '2001-11-04'"

NAMED = (
    "['FER1000','SYK1000','SYK1001','SYK1002','PER1000','PER1001','PER1002','FAG1000','ADM1003',"
    "'INT1000','INT2000','REK1000','ADM1000','SAL1000','PER1003','PER1005','REK1010','SYK1003']"
)
REASONS = "('FER1000','SYK1000','SYK1001','SYK1002','PER1000','PER1001','PER1002','FAG1000','AVS')"


def code(key: str) -> str:
    return f"CASE WHEN {key} < 18 THEN {NAMED}[CAST({key} AS INTEGER) + 1] ELSE 'P' || lpad(CAST({key} AS VARCHAR), 8, '0') END"


def booked(key: str) -> str:
    return code(f"(CASE WHEN ({key}) % 200 < 18 THEN ({key}) % 200 ELSE {key} END)")


def windows(months: int, first: str = START, last: str = END) -> str:
    return f"""SELECT CAST(m - INTERVAL {months} MONTH AS DATE) AS from_date, CAST(m - INTERVAL 1 DAY AS DATE) AS to_date
        FROM generate_series(date_trunc('month', {first}), date_trunc('month', {last}), INTERVAL 1 MONTH) g(m)"""


def weeks(first: str, last: str, days: int = 6, whole: bool = False) -> str:
    start = f"date_trunc('week', {first})" if whole else first
    stop = f"date_trunc('week', {last})" if whole else last
    return f"""SELECT CAST(date_trunc('week', d) AS DATE) AS from_date, CAST(date_trunc('week', d) AS DATE) + {days} AS to_date
        FROM generate_series(CAST({start} AS TIMESTAMP), CAST({stop} AS TIMESTAMP), INTERVAL 7 DAY) g(d)"""


MONDAY = "CAST(date_trunc('week', make_date(CAST({y} AS BIGINT), 1, 4)) AS DATE) + 7 * (CAST({w} AS INTEGER) - 1)"


def monday(year: str, week: str) -> str:
    return MONDAY.format(y=year, w=week)


# Named parts. A statement may use any of them; those it needs are put in front of it.
PARTS = {
    "employees": """SELECT CAST(s_suppkey AS INTEGER) AS id, 'E' || (s_suppkey % 7) AS first_name, s_name AS last_name,
        lower(s_name) || '@example.org' AS email, DATE '1995-01-01' + CAST(s_suppkey * 37 % 700 AS INTEGER) AS doe,
        CASE WHEN s_suppkey % 5 = 0 THEN DATE '1999-01-01' + CAST(s_suppkey * 53 % 700 AS INTEGER) END AS term,
        CASE s_suppkey % 4 WHEN 0 THEN 'Annet' WHEN 1 THEN 'Konsulent' WHEN 2 THEN 'Designer' END AS role,
        CAST(NULL AS VARCHAR) AS image_url, s_suppkey % 9 <> 0 AS permanent,
        CASE WHEN s_suppkey % 3 = 0 THEN '😀' END AS emoji
        FROM supplier""",
    "customers": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation",
    "projects": f"""SELECT {code('p_partkey')} AS id, p_name AS name,
        CASE WHEN p_partkey <= 6 OR p_partkey IN (14, 17) THEN 'unavailable'
             WHEN p_partkey <= 16 OR p_partkey % 10 = 9 THEN 'nonbillable' ELSE 'billable' END AS billable,
        CAST(p_partkey % 25 AS VARCHAR) AS customer, p_partkey % 11 <> 0 AS active,
        CAST(p_partkey % 10 AS INTEGER) AS responsible, p_partkey % 13 = 5 AS deductable
        FROM part""",
    "time_entry": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
        CAST(l_suppkey AS INTEGER) AS employee, {booked('l_partkey')} AS project, CAST(l_shipdate AS DATE) AS date,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_quantity * 30 AS INTEGER) END AS minutes,
        l_shipdate + to_days(l_linenumber) AS created
        FROM lineitem JOIN employees e ON e.id = l_suppkey
        WHERE CAST(l_shipdate AS DATE) >= e.doe AND (e.term IS NULL OR CAST(l_shipdate AS DATE) <= e.term)""",
    "planned": f"""SELECT l_linestatus AS status, CAST(l_suppkey AS INTEGER) AS employee, {booked('l_partkey')} AS project,
        CAST(l_shipdate AS DATE) AS date, CASE WHEN l_discount >= 0.05 THEN 50 ELSE 100 END AS percentage FROM lineitem""",
    "staffing": f"""SELECT employee, project, date, max(percentage) AS percentage FROM planned
        WHERE status = 'O' AND project NOT IN {REASONS} GROUP BY ALL""",
    "absence": f"""SELECT DISTINCT employee AS employee_id, date, project AS reason, 100 AS percentage FROM planned
        WHERE status = 'F' AND project IN {REASONS} AND date NOT IN (SELECT date FROM holidays)""",
    "easter": """SELECT * FROM (VALUES (DATE '1994-04-03'), (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'),
        (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15'), (DATE '2002-03-31')) v(sunday)""",
    "holidays": """SELECT sunday + CAST(o AS INTEGER) AS date, n AS name FROM easter, (VALUES (-7, 'Palmesøndag'), (-3, 'Skjærtorsdag'),
        (-2, 'Langfredag'), (1, '2. påskedag'), (39, 'Kristi himmelfartsdag'), (49, '1. pinsedag'), (50, '2. pinsedag')) v(o, n)
        UNION ALL
        SELECT make_date(year(sunday), m, d), n FROM easter, (VALUES (1, 1, '1. nyttårsdag'),
        (5, 1, 'Arbeidernes internasjonale kampdag'), (5, 17, 'Grunnlovsdag'), (12, 24, 'Julaften'), (12, 25, '1. juledag'),
        (12, 26, '2. juledag'), (12, 31, 'Nyttårsaften')) v(m, d, n)""",
    "days": """SELECT CAST(d AS DATE) AS date, isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT date FROM holidays) AS workday
        FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) g(d)""",
    "workdays": "SELECT date FROM days WHERE workday",
    "invoiced": f"""SELECT *, {booked('(o_orderkey % 200)')} AS project, last_day(o_orderdate) AS date FROM orders""",
    "invoice_balance": """SELECT project || '|' || date AS id, project, date, sum(CAST(o_totalprice AS DECIMAL(10,2))) AS amount,
        CAST(sum(o_custkey % 40 * 60) AS INTEGER) AS minutes,
        min(CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'not_done' ELSE 'ok' END) AS status
        FROM invoiced GROUP BY project, date""",
    "expense": """SELECT project || '|' || date AS invoice_balance, date AS created,
        CASE WHEN o_orderkey % 2 = 0 THEN 'subcontractor' ELSE 'other' END AS type,
        CAST(o_custkey * 7 + 100 AS DECIMAL(10,2)) AS amount FROM invoiced""",
    "write_off": """SELECT project || '|' || date AS invoice_balance, date AS created,
        CAST(o_custkey % 10 * 30 AS INTEGER) AS minutes FROM invoiced""",
    "paid_overtime": """SELECT CAST(o_custkey % 10 AS INTEGER) AS employee, CAST(o_custkey % 8 + 1 AS INTEGER) AS minutes,
        CASE WHEN o_orderkey % 100 <> 0 THEN CAST(o_orderdate AS DATE) END AS paid_date FROM orders""",
    "vacation_days": """SELECT CAST(s_suppkey AS INTEGER) AS employee_id, CAST(y AS INTEGER) AS year,
        CAST(s_suppkey % 6 + 25 AS DOUBLE) AS days_earnt
        FROM supplier, unnest(generate_series(1996, 1996 + s_suppkey % 4)) u(y)""",
    "timelock_events": """SELECT CAST(event_id AS VARCHAR) AS id, ts AS created, 0 AS creator,
        CAST(user_id % 10 AS INTEGER) AS employee, CAST(ts AS DATE) - 7 AS commit_date FROM events""",
    "employee_role": "SELECT CAST(s_suppkey AS INTEGER) AS employee_id, 'admin' AS role_type FROM supplier WHERE s_acctbal >= 5000",
    "tenure": """SELECT CAST(s_suppkey AS INTEGER) AS employee_id, DATE '1997-01-01' AS first,
        CASE WHEN s_suppkey % 2 = 1 THEN DATE '1998-06-30' END AS last FROM supplier WHERE s_acctbal < 3000""",
    "reporting_visibility": """SELECT CAST(isoyear(o_orderdate) AS INTEGER) AS year, CAST(week(o_orderdate) AS INTEGER) AS week,
        count(*) * 37.5 AS available_hours, CAST(sum(o_custkey % 38) AS DOUBLE) AS billable_hours FROM orders GROUP BY 1, 2""",
    "months": windows(1),
    "halfyears": windows(6),
    "bimonths": windows(2),
    "years_back": windows(12, "DATE '1996-01-01'", END),
    "mixed_weeks": weeks(MIXED_FIRST, MIXED_LAST, whole=True),
    # Facts with the class of their project.
    "te": "SELECT t.*, p.billable, p.customer, p.deductable FROM time_entry t JOIN projects p ON p.id = t.project",
    "st": "SELECT s.*, p.billable, p.customer FROM staffing s JOIN projects p ON p.id = s.project",
    "away": f"""SELECT a.employee_id AS employee, a.date FROM absence a JOIN projects p ON p.id = a.reason
        WHERE p.billable = 'unavailable' AND p.id IN {REASONS}""",
    # Which employees are possible on which working day.
    "blocked": """SELECT employee, date FROM st GROUP BY ALL HAVING bool_and(billable = 'unavailable')
        UNION SELECT employee, date FROM away""",
    "possible": """SELECT e.id AS employee, w.date FROM employees e JOIN workdays w ON w.date >= e.doe AND w.date <= coalesce(e.term, w.date)
        WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.employee = e.id AND b.date = w.date)""",
    "orders_in": f"""SELECT CAST(o_orderkey AS INTEGER) AS seq,
        CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 10 ELSE o_custkey % (SELECT count(*) FROM supplier) END AS INTEGER) AS employee,
        {booked('(o_orderkey % 200)')} AS project, CAST(o_orderdate AS DATE) AS start_date,
        CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 - 1 AS INTEGER) AS end_date,
        CASE WHEN o_totalprice > 200000 THEN 50 ELSE 80 END AS percentage,
        CAST(year(o_orderdate) AS INTEGER) AS year, CAST(week(o_orderdate) AS INTEGER) AS week,
        CAST(o_custkey % 4 AS INTEGER) AS days, last_day(CAST(o_orderdate AS DATE) + 20) AS date,
        CAST(o_custkey % 90 AS INTEGER) AS minutes, CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
        CASE WHEN o_orderstatus = 'F' THEN 'sent' ELSE 'not_ok' END AS status,
        CASE WHEN o_custkey % 2 = 0 THEN 'subcontractor' ELSE 'other' END AS type FROM orders""",
    "asked_days": """SELECT o.seq, o.employee, o.project, d.date, o.percentage, d.workday, isodow(d.date) < 6 AS weekday,
        o.project IN (SELECT id FROM projects WHERE id IN """
    + REASONS
    + """) OR o.project = 'AVS' AS reason
        FROM orders_in o JOIN days d ON d.date BETWEEN o.start_date AND o.end_date""",
    "before_split": f"""SELECT employee, project, date, percentage FROM staffing
        UNION ALL SELECT DISTINCT employee, project, date, 60 FROM time_entry WHERE project IN {REASONS}""",
}


def statement(body: str) -> str:
    """Put the named parts that a statement uses, directly or through other parts, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    # A statement can begin with its own parts after a leading WITH.
    own = re.match(r"\s*WITH\s+(.*)", body, re.S)
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in needed)
    if own:
        return f"WITH {parts},\n{own.group(1)}" if parts else body
    return f"WITH {parts}\n{body}" if parts else body


_SQL: dict[str, str] = {}


def all_twins() -> dict[str, str]:
    return {name: statement(body) for name, body in _SQL.items()}


NAME = "e.first_name || ' ' || e.last_name"
EMPLOYED = "e.doe <= w.to_date AND (e.term IS NULL OR e.term >= w.from_date)"
INSIDE = "BETWEEN w.from_date AND w.to_date"


def workdays_of(first: str, last: str) -> str:
    return f"(SELECT count(*) FROM workdays k WHERE k.date BETWEEN {first} AND {last})"


# A

_SQL["a1_is_weekday"] = "SELECT isodow(date) < 6 AS weekday, count(*) AS entries FROM time_entry GROUP BY 1"
_SQL["a2_is_holiday"] = "SELECT date, count(*) AS entries FROM time_entry WHERE date IN (SELECT date FROM holidays) GROUP BY 1"
_SQL["a3_week_dates"] = f"""SELECT y AS year, w AS week, {monday('y', 'w')} + CAST(i AS INTEGER) AS date
    FROM (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y, CAST(week(date) AS INTEGER) AS w FROM staffing), generate_series(0, 6) g(i)"""
_SQL["a4_is_date_in_week"] = """SELECT employee, year(date) = year(created) AND week(date) = week(created) AS same_week, count(*) AS entries
    FROM time_entry GROUP BY 1, 2"""
_SQL["a5_available_dates"] = f"""SELECT from_date, to_date, count(*) AS available, min(k.date) AS first_date, max(k.date) AS last_date
    FROM (SELECT DISTINCT doe AS from_date, coalesce(term, {LAST_DAY}) AS to_date FROM employees) w
    JOIN workdays k ON k.date {INSIDE} GROUP BY 1, 2"""
_SQL["a6_business_hours"] = """SELECT employee, CAST(sum(n) * 7.5 AS DOUBLE) AS business_hours
    FROM (SELECT employee, date, CAST(created AS DATE) AS until, count(*) AS k FROM time_entry GROUP BY ALL) t
    JOIN LATERAL (SELECT t.k * count(*) AS n FROM workdays w WHERE w.date BETWEEN t.date AND t.until) c ON true GROUP BY 1"""
_SQL["a7_month_dates"] = f"""SELECT id AS employee, CAST(m - INTERVAL 6 MONTH AS DATE) AS from_date, CAST(m - INTERVAL 1 DAY AS DATE) AS to_date
    FROM employees, unnest(generate_series(date_trunc('month', doe), CAST(coalesce(term, {LAST_DAY}) AS TIMESTAMP), INTERVAL 1 MONTH)) u(m)"""
_SQL["a8_accumulated_date_periods"] = f"""SELECT id AS employee, greatest(make_date(year(m), 1, 1), doe) AS start_date, last_day(m) AS end_date
    FROM employees, unnest(generate_series(date_trunc('month', doe), CAST(coalesce(term, {LAST_DAY}) AS TIMESTAMP), INTERVAL 1 MONTH)) u(m)"""
_SQL["a9_iso_weeks_of_year"] = f"""SELECT y AS year, CAST(n AS INTEGER) AS week_number, {monday('y', 'n')} AS week_start,
    (SELECT nullif(count(*), 0) FROM time_entry t WHERE isoyear(t.date) = y AND week(t.date) = n) AS entries
    FROM (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y FROM time_entry), unnest(generate_series(1, week(make_date(y, 12, 28)))) u(n)"""
_SQL["a10_holidays_dimension"] = """SELECT h.date, h.name, count(t.date) AS entries FROM (
    SELECT date, name FROM holidays
    UNION ALL SELECT make_date(CAST(y AS BIGINT), 12, CAST(d AS BIGINT)), 'Julefri' FROM (VALUES (1997), (2000)) v(y), generate_series(27, 30) g(d)) h
    LEFT JOIN time_entry t ON t.date = h.date GROUP BY 1, 2"""

# B

_SQL["b1_is_absence_reason"] = f"SELECT project IN {REASONS} AS is_reason, count(*) AS entries, CAST(sum(minutes) AS BIGINT) AS minutes FROM time_entry GROUP BY 1"
_SQL["b2_absence_reasons"] = f"""SELECT id, name, billable FROM projects WHERE id IN {REASONS}
    UNION ALL SELECT 'AVS', 'Avspasering', 'nonbillable'"""
_SQL["b3_absence_spent"] = f"""SELECT employee AS employee_id, date, project AS reason, CAST(sum(minutes) AS BIGINT) AS minutes
    FROM te WHERE project IN {REASONS} GROUP BY 1, 2, 3 HAVING sum(minutes) > 0"""
_SQL["b4_available_projects"] = f"""SELECT p.id, p.name, p.billable, p.active, c.id AS customer_id, c.name AS customer_name
    FROM projects p LEFT JOIN customers c ON c.id = p.customer WHERE p.active AND p.id NOT IN {REASONS}"""
_ROLES = """SELECT e.id, e.email, coalesce(string_agg(r.role_type, ',' ORDER BY r.role_type), '') AS roles
    FROM employees e LEFT JOIN employee_role r ON r.employee_id = e.id WHERE {which} GROUP BY e.id, e.email"""
_SQL["b5a_employees_roles_by_id"] = _ROLES.format(which="e.id IN (SELECT employee_id FROM absence)")
_SQL["b5b_employees_roles"] = _ROLES.format(which="true")
_SQL["b5c_employees_roles_by_email"] = _ROLES.format(which="e.term IS NOT NULL")
_SQL["b6_employees_in_dates"] = f"""SELECT w.from_date, w.to_date, e.id AS employee_id, e.first_name, e.last_name, e.role, e.image_url
    FROM employees e JOIN months w ON {EMPLOYED}"""
_SQL["b7_projects_info_for_employee_in_period"] = """WITH asked AS (
    SELECT id AS employee, CASE id % 4 WHEN 0 THEN '[' || doe || ',' || (doe + 400) || ')'
        WHEN 1 THEN '(' || doe || ', ' || (doe + 400) || ']' WHEN 2 THEN '[' || (doe + 400) || ',)'
        ELSE '(,' || (doe + 400) || ']' END AS date_range,
      CASE id % 4 WHEN 0 THEN doe WHEN 1 THEN doe + 1 WHEN 2 THEN doe + 400 ELSE DATE '1900-01-01' END AS first,
      CASE id % 4 WHEN 0 THEN doe + 399 WHEN 1 THEN doe + 400 WHEN 2 THEN DATE '2100-01-01' ELSE doe + 400 END AS last
    FROM employees)
  SELECT DISTINCT a.employee, a.date_range, p.id, p.name, p.active, c.id AS customer_id, c.name AS customer_name
  FROM asked a JOIN time_entry t ON t.employee = a.employee AND t.date BETWEEN a.first AND a.last
  JOIN projects p ON p.id = t.project JOIN customers c ON c.id = p.customer"""
_SQL["b8_employees_on_projects"] = """SELECT DISTINCT w.from_date, w.to_date, c.id AS customer_id, c.name AS customer_name,
    e.first_name, e.last_name, e.id, e.emoji
    FROM st s JOIN months w ON s.date > w.from_date AND s.date < w.to_date
    JOIN customers c ON c.id = s.customer JOIN employees e ON e.id = s.employee WHERE s.billable = 'billable'"""


def _responsible(back: int, ahead: int, also: str) -> str:
    return f"""WITH totals AS (SELECT s.employee, s.project, p.responsible, count(*) AS n
        FROM staffing s JOIN projects p ON p.id = s.project AND p.active
        WHERE s.date > {AS_OF} - {back} AND s.date < {AS_OF} + {ahead} {also} GROUP BY ALL)
    SELECT employee, responsible AS project_responsible FROM totals
    QUALIFY row_number() OVER (PARTITION BY employee ORDER BY n DESC, project) = 1"""


_SQL["b9a_employee_project_responsible_v1"] = _responsible(15, 14, "")
_SQL["b9b_employee_project_responsible"] = _responsible(22, 21, "AND s.project <> 'FER1000'")
_SQL["b10_number_of_employees_in_period"] = f"""SELECT w.from_date, w.to_date, count(e.id) AS employee_count
    FROM months w LEFT JOIN employees e ON {EMPLOYED} AND e.permanent GROUP BY 1, 2"""
_SQL["b11_employee_has_sick_child_days"] = """SELECT id AS employee,
    id IN (SELECT employee FROM time_entry WHERE project = 'SYK1002') AS has_sick_child_days FROM employees"""
_SQL["b12_projects_for_employee_for_date"] = f"""WITH kinds AS (
    SELECT employee, date, project, CAST(0 AS BIGINT) AS minutes, percentage, 0 AS internal FROM staffing
    UNION ALL SELECT employee, date, project, coalesce(sum(minutes), 0), 0, 0 FROM time_entry GROUP BY ALL
    UNION ALL SELECT employee_id, date, reason, 0, percentage, 1 FROM absence)
  SELECT k.employee, k.date, k.project AS id, p.name AS project,
    CASE WHEN bool_and(internal = 1) THEN 'Internt' WHEN bool_or(internal = 1) THEN greatest(any_value(c.name), 'Internt')
         ELSE any_value(c.name) END AS customer,
    CAST(sum(k.minutes) AS BIGINT) AS minutes, CAST(sum(k.percentage) AS BIGINT) AS percentage_staffed
  FROM kinds k JOIN projects p ON p.id = k.project JOIN customers c ON c.id = p.customer
  WHERE k.date BETWEEN {START} AND {END} GROUP BY k.employee, k.date, k.project, p.name"""

# C

_SQL["c1_accumulated_hours_for_employee"] = f"""SELECT e.id AS employee, w.from_date, w.to_date, coalesce(sum(t.minutes), 0) / 60.0 AS hours
    FROM employees e CROSS JOIN months w LEFT JOIN time_entry t ON t.employee = e.id AND t.date {INSIDE} GROUP BY ALL"""
_SQL["c2_accumulated_overtime_for_employee"] = f"""SELECT e.id AS employee, x.d AS end_date,
    CASE WHEN e.term IS NULL OR x.d <= e.term THEN
      (SELECT coalesce(sum(minutes), 0) FROM time_entry t WHERE t.employee = e.id AND t.date BETWEEN e.doe AND x.d) / 60.0
      - {workdays_of('e.doe', 'x.d')} * 7.5
      - (SELECT coalesce(sum(minutes), 0) FROM paid_overtime o WHERE o.employee = e.id AND o.paid_date <= x.d) / 60.0 END AS overtime,
    coalesce(x.d > e.term, false) AS after_termination
    FROM employees e, (VALUES ({AS_OF}), ({WHOLE_LAST})) x(d)"""
_SQL["c2_accumulated_overtime_failing_form"] = f"""SELECT e.id AS employee, x.d AS end_date,
    (SELECT coalesce(sum(minutes), 0) FROM time_entry t WHERE t.employee = e.id AND t.date BETWEEN e.doe AND x.d) / 60.0
    - {workdays_of('e.doe', 'x.d')} * 7.5
    - (SELECT coalesce(sum(minutes), 0) FROM paid_overtime o WHERE o.employee = e.id AND o.paid_date <= x.d) / 60.0 AS overtime
    FROM employees e, LATERAL (SELECT least(coalesce(e.term, {WHOLE_LAST}), {WHOLE_LAST}) AS d) x"""
_SQL["c3_entries_sums_with_project"] = f"""SELECT e.id AS for_employee, d.date AS work_date, t.employee, t.project, sum(t.minutes) / 60.0 AS hours
    FROM employees e JOIN days d ON d.date BETWEEN {WHOLE_FIRST} AND {WHOLE_LAST}
    LEFT JOIN time_entry t ON t.employee = e.id AND t.date = d.date GROUP BY ALL"""
_SQL["c4_entries_sums_for_employee"] = """SELECT employee, date, CAST(sum(minutes) AS BIGINT) AS sum FROM time_entry
    WHERE date >= DATE '1995-01-02' AND date < DATE '1995-01-02' + 2530 GROUP BY 1, 2"""
_HOURS_BY_DAY = f"""SELECT e.id, {NAME} AS name, d.date, round(sum(t.minutes) / 60.0, 1) AS hours
    FROM employees e JOIN days d ON d.date BETWEEN {{first}} AND {{last}}
    LEFT JOIN time_entry t ON t.employee = e.id AND t.date = d.date GROUP BY ALL"""
_SQL["c5_hours_per_employee"] = _HOURS_BY_DAY.format(first="DATE '1995-01-01'", last="DATE '2001-12-31'")
_SQL["c5_hours_per_employee_json"] = f"""SELECT name, '[' || string_agg('{{"' || date || '":' || coalesce(CAST(hours AS VARCHAR), 'null') || '}}', ',' ORDER BY date)
    || ']' AS hours FROM ({_HOURS_BY_DAY.format(first=YEAR_FIRST, last=YEAR_LAST)}) GROUP BY id, name"""
_SQL["c6_accumulated_entries_on_project"] = f"""SELECT w.from_date, w.to_date, CAST(sum(t.minutes) AS BIGINT) // 60 AS hours, p.id AS project, p.billable, p.name
    FROM time_entry t JOIN projects p ON p.id = t.project JOIN months w ON t.date {INSIDE} GROUP BY ALL"""
for _key, _class in [
    ("c7_unavailable_hours_for_employees", "unavailable"),
    ("c8_billable_hours_for_employees", "billable"),
    ("c9_nonbillable_hours_for_employees", "nonbillable"),
]:
    _SQL[_key] = f"""SELECT w.from_date, w.to_date, t.employee AS id, CAST(sum(t.minutes) AS BIGINT) AS sum
        FROM te t JOIN months w ON t.date {INSIDE} WHERE t.billable = '{_class}' GROUP BY 1, 2, 3"""


def _unregistered(periods: str) -> str:
    """Working days per employee and period without an entry."""
    return f"""SELECT e.id AS employee, w.from_date, w.to_date,
        CAST((SELECT count(*) FROM workdays k WHERE k.date {INSIDE})
           - (SELECT count(DISTINCT t.date) FROM time_entry t JOIN workdays k ON k.date = t.date
              WHERE t.employee = e.id AND t.date {INSIDE}) AS INTEGER) AS unregistered_days
        FROM employees e CROSS JOIN {periods} w"""


_SQL["c10_unregistered_days"] = _unregistered("months")


def _status(periods: str, planned: bool, keys: str) -> str:
    staffed_b = "coalesce(s.b, 0) * 7.5 / 100 AS staffed_billable_hours," if planned else ""
    staffed_n = "coalesce(s.n, 0) * 7.5 / 100 AS staffed_nonbillable_hours," if planned else ""
    absent = "coalesce(a.n, 0) * CAST(7.5 AS DOUBLE) AS unavailable_absence_hours," if planned else ""
    return f"""WITH missing AS ({_unregistered(periods)}),
    worked AS (SELECT t.employee, w.from_date, sum(minutes) FILTER (billable = 'billable') AS b,
        sum(minutes) FILTER (billable = 'nonbillable') AS n, sum(minutes) FILTER (billable = 'unavailable') AS u
        FROM te t JOIN {periods} w ON t.date {INSIDE} GROUP BY 1, 2),
    staffed AS (SELECT s.employee, w.from_date, sum(percentage) FILTER (billable = 'billable') AS b,
        sum(percentage) FILTER (billable = 'nonbillable') AS n FROM st s JOIN {periods} w ON s.date {INSIDE} GROUP BY 1, 2),
    absent AS (SELECT a.employee_id AS employee, w.from_date, count(*) AS n
        FROM absence a JOIN projects p ON p.id = a.reason AND p.billable = 'unavailable' JOIN {periods} w ON a.date {INSIDE} GROUP BY 1, 2),
    newest AS (SELECT employee, max(date) AS last_date, CASE WHEN count(*) = count(created) THEN CAST(max(created) AS DATE) END AS last_created
        FROM time_entry GROUP BY 1),
    able AS (SELECT e.id, w.from_date, count(*) AS n FROM employees e JOIN {periods} w ON true
        JOIN workdays k ON k.date BETWEEN greatest(e.doe, w.from_date) AND least(e.term, w.to_date) GROUP BY 1, 2)
    SELECT {keys}, e.id, {NAME} AS name, e.email, coalesce(k.n, 0) * 7.5 - coalesce(t.u, 0) / 60.0 AS available_hours,
      {staffed_b} coalesce(t.b, 0) / 60.0 AS billable_hours, {staffed_n} coalesce(t.n, 0) / 60.0 AS non_billable_hours,
      {absent} coalesce(t.u, 0) / 60.0 AS unavailable_hours, m.unregistered_days, l.last_date, l.last_created
    FROM employees e JOIN {periods} w ON {EMPLOYED}
    JOIN missing m ON m.employee = e.id AND m.from_date = w.from_date
    LEFT JOIN able k ON k.id = e.id AND k.from_date = w.from_date
    LEFT JOIN worked t ON t.employee = e.id AND t.from_date = w.from_date
    LEFT JOIN staffed s ON s.employee = e.id AND s.from_date = w.from_date
    LEFT JOIN absent a ON a.employee = e.id AND a.from_date = w.from_date
    LEFT JOIN newest l ON l.employee = e.id"""


PARTS["stepped_weeks"] = weeks(START, END)
_SQL["c11_time_tracking_status"] = _status("months", False, "w.from_date, w.to_date")
_SQL["c12_time_tracking_status_with_staffing"] = _status("months", True, "w.from_date, w.to_date")
_SQL["c13_time_tracking_status_by_week"] = _status("stepped_weeks", True, "w.from_date AS week_start")


def _employee_hours(periods: str) -> str:
    return f"""hours AS (SELECT e.id AS employee, w.*,
        coalesce(k.n, 0) * 7.5 - coalesce(t.u, 0) / 60.0 AS available, coalesce(t.b, 0) / 60.0 AS billable, coalesce(t.x, 0) / 60.0 AS extra
        FROM employees e CROSS JOIN {periods} w
        LEFT JOIN (SELECT t.employee, v.from_date, sum(minutes) FILTER (billable = 'billable') AS b,
            sum(minutes) FILTER (billable = 'unavailable') AS u, sum(minutes) FILTER (project IN ('PER1005', 'REK1010')) AS x
            FROM te t JOIN {periods} v ON t.date BETWEEN v.from_date AND v.to_date GROUP BY 1, 2) t
          ON t.employee = e.id AND t.from_date = w.from_date
        LEFT JOIN (SELECT f.id, v.from_date, count(*) AS n FROM employees f JOIN {periods} v ON true
            JOIN workdays d ON d.date BETWEEN greatest(f.doe, v.from_date) AND least(f.term, v.to_date) GROUP BY 1, 2) k
          ON k.id = e.id AND k.from_date = w.from_date)"""


PARTS["iso_weeks"] = f"""SELECT y AS year, CAST(n AS INTEGER) AS number, {monday('y', 'n')} AS from_date, {monday('y', 'n')} + 6 AS to_date
    FROM (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS y), unnest(generate_series(1, week(make_date(y, 12, 28)))) u(n)"""
_SQL["c14_fg_for_employee"] = f"""WITH {_employee_hours('months')}
    SELECT from_date, to_date, employee, available AS available_hours, billable AS billable_hours FROM hours"""
_SQL["c15_bonus_hours_for_employee"] = f"""WITH {_employee_hours('months')}
    SELECT from_date, to_date, employee, available AS available_hours, billable + extra AS bonus_billable_hours FROM hours"""
_SQL["c16_employee_yearly_bonus"] = f"""WITH {_employee_hours('iso_weeks')}
    SELECT h.employee, h.year, CAST(sum(CASE WHEN available <= 0 THEN 0
        WHEN (billable + extra) / available > 0.95 THEN 750 + 250 * CAST(held AS INTEGER)
        WHEN (billable + extra) / available > 0.90 THEN 500 + 250 * CAST(held AS INTEGER) ELSE 0 END) AS INTEGER) AS bonus
    FROM (SELECT *, EXISTS (SELECT 1 FROM tenure r WHERE r.employee_id = hours.employee AND r.first <= hours.to_date
        AND coalesce(r.last, hours.from_date) >= hours.from_date) AS held FROM hours) h GROUP BY 1, 2"""
_SQL["c17_employee_weekly_fg"] = f"""WITH {_employee_hours('iso_weeks')}
    SELECT employee, year, number AS week_number, from_date AS week_start, available AS available_hours, billable AS billable_hours
    FROM hours WHERE year BETWEEN 1995 AND 2001"""
_SQL["c18_time_distribution"] = f"""SELECT w.from_date, w.to_date,
    CASE WHEN count(t.date) > 0 THEN count(t.date) FILTER (t.billable = 'billable') * CAST(7.5 AS DOUBLE) END AS billable_hours,
    CASE WHEN count(t.date) > 0 THEN count(t.date) FILTER (t.billable = 'nonbillable') * CAST(7.5 AS DOUBLE) END AS nonbillable_hours,
    CASE WHEN count(t.date) > 0 THEN count(t.date) FILTER (t.billable = 'unavailable') * CAST(7.5 AS DOUBLE) END AS unavailable_hours
    FROM months w LEFT JOIN te t ON t.date {INSIDE} GROUP BY 1, 2"""
for _key, _test, _column in [
    ("c19_total_hours_on_project_in_period", "t.project = 'FAG1000'", "project_hours"),
    ("c20_sick_hours", "t.project = 'SYK1000'", "sick_hours"),
    ("c21_unavailable_time_entry_hours", "t.billable = 'unavailable'", "unavailable_hours"),
]:
    _SQL[_key] = f"""SELECT w.from_date, w.to_date, sum(t.minutes) / 60.0 AS {_column}
        FROM months w LEFT JOIN te t ON t.date {INSIDE} AND {_test} GROUP BY 1, 2"""
_SQL["c22_product_development_hours"] = f"""SELECT w.from_date, w.to_date, coalesce(sum(t.minutes), 0) / 60.0 AS hours
    FROM months w LEFT JOIN te t ON t.date {INSIDE} AND t.deductable GROUP BY 1, 2"""


def _report_line(label: str, condition: str) -> str:
    return f"""SELECT w.from_date, w.to_date, '{label}' AS prosjekt,
        (SELECT round(sum(t.minutes) / 60.0, 2) FROM time_entry t JOIN employees e ON e.id = t.employee
         WHERE t.date {INSIDE} AND {condition}) AS timer FROM months w"""


_SQL["c23_get_periodic_report"] = f"""WITH status AS ({_status('months', False, 'w.from_date, w.to_date').replace('WITH missing', 'WITH missing', 1)}),
  labels AS (SELECT * FROM (VALUES ('FAG1000', 'Fagutvikling'), ('ADM1003', 'Åremålsadmin'), ('INT1000', 'Internsystemer'),
    ('INT2000', 'Internsystemer'), ('PER1000', 'Perm med lønn'), ('REK1000', 'Rekruttering'), ('SYK1001', 'Sykemelding'),
    ('SYK1002', 'Sykt barn'), ('SYK1003', 'SYK1003')) v(project, label)),
  totals AS (SELECT w.from_date, w.to_date, sum(s.b) AS b, sum(s.k) AS k, sum(s.u) AS u FROM months w LEFT JOIN (
      SELECT v.from_date, coalesce(round(billable_hours * 60), 0) AS b, coalesce(round(unavailable_hours * 60), 0) AS u,
        round((available_hours + unavailable_hours) / 7.5) AS k FROM status v) s ON s.from_date = w.from_date GROUP BY 1, 2)
  SELECT w.from_date, w.to_date, l.label AS prosjekt, round(sum(t.minutes) / 60.0, 2) AS timer
  FROM months w JOIN time_entry t ON t.date {INSIDE} JOIN labels l ON l.project = t.project GROUP BY 1, 2, 3
  UNION ALL {_report_line('Sykdom (inkl barn)', "t.project IN ('SYK1000', 'SYK1002')")}
  UNION ALL {_report_line('Foreldreperm', "t.project IN ('PER1002', 'PER1003', 'PER1004')")}
  UNION ALL {_report_line('Ferie', "t.project = 'FER1000'")}
  UNION ALL SELECT from_date, to_date, 'Fakturerbart', b / 60.0 FROM totals
  UNION ALL SELECT from_date, to_date, 'Totalt tilgjengelig', k * 7.5 - u / 60.0 FROM totals
  UNION ALL {_report_line('Admin og Salg ført av admin/ledelse', "e.role = 'Annet' AND t.project IN ('ADM1000', 'SAL1000')")}
  UNION ALL {_report_line('Salg ført av andre', "e.role <> 'Annet' AND t.project = 'SAL1000'")}
  UNION ALL {_report_line('Admin ført av andre', "e.role <> 'Annet' AND t.project = 'ADM1000'")}"""

# D

for _key, _class in [
    ("d1_staffed_billable_hours_for_employees", "billable"),
    ("d2_staffed_nonbillable_hours_for_employees", "nonbillable"),
]:
    _SQL[_key] = f"""SELECT w.from_date, w.to_date, s.employee AS id, sum(s.percentage) * 7.5 / 100 AS hours
        FROM st s JOIN months w ON s.date {INSIDE} WHERE s.billable = '{_class}' GROUP BY 1, 2, 3"""
_SQL["d3_unavailable_absence_days_for_employees"] = f"""SELECT w.from_date, w.to_date, a.employee_id AS id, count(*) AS days
    FROM absence a JOIN projects p ON p.id = a.reason AND p.billable = 'unavailable' JOIN months w ON a.date {INSIDE} GROUP BY 1, 2, 3"""
_SQL["d4_staffed_hours"] = """SELECT coalesce(s.employee, a.employee) AS employee, coalesce(s.date, a.date) AS date,
    CAST(CASE WHEN s.p IS NULL THEN 0 WHEN a.p IS NULL OR s.p + a.p <= 100 THEN s.p ELSE 100 - a.p END * 0.375 AS DOUBLE) AS total_staffed_hours
    FROM (SELECT employee, date, sum(percentage) AS p FROM staffing WHERE date NOT IN (SELECT date FROM holidays) GROUP BY 1, 2) s
    FULL JOIN (SELECT employee_id AS employee, date, sum(percentage) AS p FROM absence GROUP BY 1, 2) a
      ON a.employee = s.employee AND a.date = s.date"""
PARTS["free"] = f"""SELECT g.employee, g.year, g.week, k.date FROM
    (SELECT DISTINCT employee, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week FROM staffing) g
    JOIN workdays k ON k.date BETWEEN {monday('g.year', 'g.week')} AND {monday('g.year', 'g.week')} + 6
    WHERE NOT EXISTS (SELECT 1 FROM staffing s WHERE s.employee = g.employee AND s.date = k.date)
      AND NOT EXISTS (SELECT 1 FROM absence a WHERE a.employee_id = g.employee AND a.date = k.date)"""
_SQL["d5_available_dates"] = "SELECT employee, year, week, date AS available_date FROM free"


def _buckets(start: str) -> str:
    return f"""SELECT s.employee, string_agg(s.project, ',' ORDER BY s.project) AS projects, g.m AS start_of_week, CAST(count(*) AS INTEGER) AS days
        FROM staffing s JOIN (SELECT {start} + 7 * CAST(i AS INTEGER) AS m FROM generate_series(0, 361) g(i)) g
          ON s.date BETWEEN g.m AND g.m + 6 JOIN employees e ON e.id = s.employee GROUP BY 1, 3"""


_SQL["d6_worked_days_per_week"] = _buckets("DATE '1995-01-01'")
_SQL["d7_employee_worked_days_per_week"] = _buckets("DATE '1995-01-02'")
_SQL["d8_get_weekly_staffing_dates"] = f"""SELECT s.employee AS employee_id, e.first_name, e.last_name, e.doe AS date_of_employment,
    e.term AS termination_date, CAST(year(s.date) AS INTEGER) AS year, CAST(week(s.date) AS INTEGER) AS week,
    string_agg(CAST(day(s.date) AS VARCHAR), ',' ORDER BY day(s.date)) AS days, s.project AS project_id, count(*) AS n_days
    FROM staffing s LEFT JOIN employees e ON e.id = s.employee
    WHERE s.date BETWEEN date_trunc('week', {START}) AND date_trunc('week', {END}) + INTERVAL 6 DAY GROUP BY ALL"""


def _availability(employee: str, first: str, last: str) -> str:
    possible = f"(SELECT count(*) FROM workdays k WHERE k.date BETWEEN {first} AND {last})"
    gone = f"(SELECT count(*) FROM away x WHERE x.employee = {employee} AND x.date BETWEEN {first} AND {last})"
    return f"CASE WHEN {possible} = 0 THEN 0 ELSE greatest(round(({possible} - {gone}) * 100.0 / {possible}, 2), 0) END"


_SQL["d9_get_weekly_staffing"] = f"""WITH bounds AS (SELECT CAST(date_trunc('week', {MIXED_FIRST}) AS DATE) AS lo, CAST(date_trunc('week', {MIXED_LAST}) AS DATE) + 6 AS hi),
    both_kinds AS (SELECT employee, project, date, percentage FROM staffing UNION ALL SELECT employee_id, reason, date, 100 FROM absence),
    cells AS (SELECT employee, project, date, max(percentage) AS percentage, CAST(date_trunc('week', date) AS DATE) AS m
        FROM both_kinds, bounds WHERE date BETWEEN lo AND hi GROUP BY ALL),
    shares AS (SELECT employee, m, CAST({_availability('c.employee', 'c.m', 'c.m + 6')} AS DOUBLE) AS availability
        FROM (SELECT DISTINCT employee, m FROM cells) c)
    SELECT e.id AS employee_id, e.first_name, e.last_name, e.role, c.project, p.name AS project_name, p.billable,
      strftime(c.m, '%G-%V') AS week, h.availability, c.date, c.percentage
    FROM (SELECT * FROM employees WHERE doe <= {MIXED_LAST} AND (term IS NULL OR term >= {MIXED_FIRST})) e
    LEFT JOIN cells c ON c.employee = e.id LEFT JOIN shares h ON h.employee = c.employee AND h.m = c.m LEFT JOIN projects p ON p.id = c.project"""


_SQL["d9_get_weekly_staffing_json"] = f"""SELECT employee_id AS id, concat_ws(' ', first_name, last_name) AS name, role,
    CAST(NULL AS VARCHAR) AS image_url, project, billable, project_name, week, availability, CAST(date AS VARCHAR) AS date, percentage
    FROM ({_SQL["d9_get_weekly_staffing"]})"""


def _week_object(rows: str, value: str) -> str:
    """One JSON text from the labels of weeks to a value."""
    return f"""SELECT '{{' || string_agg('"' || week || '":' || coalesce({value}, 'null'), ',' ORDER BY week) || '}}' AS result FROM ({rows})"""


def _company_availability(periods: str) -> str:
    return f"""SELECT w.from_date, w.to_date, CASE WHEN possible = 0 THEN 0 ELSE greatest(round((possible - gone) * 100.0 / possible, 2), 0) END AS availability
      FROM (SELECT w.from_date, w.to_date,
        (SELECT count(*) FROM workdays k WHERE k.date {INSIDE}) * (SELECT count(*) FROM employees e WHERE {EMPLOYED}) AS possible,
        (SELECT count(*) FROM away a JOIN employees e ON e.id = a.employee WHERE a.date {INSIDE} AND {EMPLOYED}) AS gone
        FROM {periods} w) w"""


_SQL["d10_availability_percentage"] = f"SELECT from_date, to_date, CAST(availability AS DOUBLE) AS availability FROM ({_company_availability('months')})"
_SQL["d10_availability_percentage_of_employee"] = f"""SELECT e.id AS employee, w.from_date, w.to_date,
    CAST({_availability('e.id', 'w.from_date', 'w.to_date')} AS DOUBLE) AS availability FROM employees e CROSS JOIN months w"""
PARTS["eight_day_weeks"] = weeks(MIXED_FIRST, MIXED_LAST, days=7, whole=True)
_SQL["d11_weekly_availability"] = f"""SELECT strftime(from_date, '%G-%V') AS week, CAST(round(CAST(availability AS DECIMAL(7,2)), 1) AS DOUBLE) AS availability
    FROM ({_company_availability('eight_day_weeks')})"""


# One row per counted day of the forecast, cut to employment before any period is looked at.
PARTS["forecast_days"] = """SELECT 'all' AS kind, k.date FROM employees e JOIN workdays k ON k.date >= e.doe AND k.date <= coalesce(e.term, k.date)
    UNION ALL SELECT 'staffed', x.date FROM st x JOIN employees e ON e.id = x.employee
      WHERE x.billable = 'unavailable' AND x.date >= e.doe AND x.date <= coalesce(e.term, x.date)
    UNION ALL SELECT 'absent', x.date FROM away x JOIN employees e ON e.id = x.employee WHERE x.date >= e.doe AND x.date <= coalesce(e.term, x.date)
    UNION ALL SELECT 'planned', date FROM st WHERE billable = 'billable'"""


def _forecast(periods: str) -> str:
    return f"""SELECT w.from_date, w.to_date, count(*) FILTER (kind = 'all') * 7.5 AS all_hours, count(*) FILTER (kind = 'staffed') * 7.5 AS staffed,
        count(*) FILTER (kind = 'absent') * 7.5 AS absent, count(*) FILTER (kind = 'planned') * 7.5 AS planned
        FROM {periods} w LEFT JOIN (SELECT date, kind FROM forecast_days) x ON x.date {INSIDE} GROUP BY 1, 2"""


_SQL["d12_weekly_forecasted_fg"] = f"""SELECT strftime(from_date, '%G-%V') AS week,
    CAST(trunc(planned / nullif(all_hours - staffed - absent, 0) * 100) AS BIGINT) AS percent FROM ({_forecast('mixed_weeks')})"""
_SQL["d13_weekly_fg"] = f"""WITH sums AS (SELECT w.from_date,
      (SELECT coalesce(sum(percentage), 0) FROM st s WHERE s.billable = 'billable' AND s.date {INSIDE}) * 7.5 / 100 AS billable,
      ((SELECT count(*) FROM employees e WHERE {EMPLOYED}) * (SELECT count(*) FROM workdays k WHERE k.date {INSIDE})
       - (SELECT count(*) FROM away a WHERE a.date {INSIDE})) * 7.5 AS available FROM mixed_weeks w)
    SELECT strftime(from_date, '%G-%V') AS week,
      CASE WHEN available > 0 THEN round(CAST(billable AS DOUBLE) / CAST(available AS DOUBLE) * 100, 1) ELSE 0 END AS fg FROM sums"""
PARTS["hired_weeks"] = weeks(HIRED_FIRST, HIRED_LAST, whole=True)
_SQL["d12_weekly_forecasted_fg_failing_form"] = _SQL["d12_weekly_forecasted_fg"].replace("mixed_weeks", "hired_weeks")
_SQL["d11_weekly_availability_json"] = _week_object(_SQL["d11_weekly_availability"], "CAST(CAST(availability AS DECIMAL(6,1)) AS VARCHAR)")
_SQL["d12_weekly_forecasted_fg_json"] = _week_object(_SQL["d12_weekly_forecasted_fg_failing_form"], "CAST(percent AS VARCHAR)")
_SQL["d13_weekly_fg_json"] = _week_object(_SQL["d13_weekly_fg"], "CAST(fg AS VARCHAR)")
_SQL["d14_unavailable_staffing_hours"] = f"""SELECT w.from_date, w.to_date, CAST(count(s.date) * 7.5 AS DOUBLE) AS unavailable_hours
    FROM months w LEFT JOIN st s ON s.date {INSIDE} AND s.billable = 'unavailable' GROUP BY 1, 2"""
_SQL["d15_planned_billable_hours"] = f"""SELECT w.from_date, w.to_date, CAST(count(s.date) * 7.5 AS DOUBLE) AS billable_hours
    FROM months w LEFT JOIN st s ON s.date {INSIDE} AND s.billable = 'billable' GROUP BY 1, 2"""
_SQL["d16_forcasted_fg_in_period"] = f"""SELECT from_date, to_date, CAST(planned AS DOUBLE) AS planned_billable_hours,
    CAST(all_hours - staffed - absent AS DOUBLE) AS available_hours,
    CAST(planned AS DOUBLE) / CAST(all_hours - staffed - absent AS DOUBLE) * 100 AS percent FROM ({_forecast('months')})"""
_SQL["d17_unavailable_staffing_dates_in_period"] = """SELECT w.from_date, w.to_date, e.id AS employee_id, s.date AS work_day
    FROM st s JOIN employees e ON e.id = s.employee
    JOIN months w ON s.date BETWEEN greatest(w.from_date, e.doe) AND least(e.term, w.to_date) WHERE s.billable = 'unavailable'"""
_SQL["d18_all_employee_work_dates_in_period"] = f"""SELECT {WHOLE_FIRST} AS from_date, {WHOLE_LAST} AS to_date, e.id AS employee_id, k.date AS work_date
    FROM employees e JOIN workdays k ON k.date BETWEEN greatest({WHOLE_FIRST}, e.doe) AND least(e.term, {WHOLE_LAST})"""
_SQL["d19_all_absence_dates_in_period"] = """SELECT w.from_date, w.to_date, e.id AS employee_id, a.date AS absence_date
    FROM away a JOIN employees e ON e.id = a.employee
    JOIN months w ON a.date BETWEEN greatest(w.from_date, e.doe) AND least(e.term, w.to_date)"""
_SQL["d20_forcasted_available_hours"] = f"""SELECT from_date, to_date, CAST(all_hours AS DOUBLE) AS all_hours,
    CAST(staffed AS DOUBLE) AS unavail_staffing_hours, CAST(absent AS DOUBLE) AS unavail_absence_hours,
    CAST(all_hours - staffed - absent AS DOUBLE) AS available_hours FROM ({_forecast('months')})"""
_SQL["d21_is_possible_work_day"] = """SELECT t.employee, t.date, p.date IS NOT NULL AS is_possible
    FROM (SELECT DISTINCT employee, date FROM time_entry) t LEFT JOIN possible p ON p.employee = t.employee AND p.date = t.date"""
_SQL["d22_possible_work_dates_per_employee"] = f"""SELECT {WHOLE_FIRST} AS from_date, {WHOLE_LAST} AS to_date, employee AS employee_id, date AS work_day
    FROM possible WHERE date BETWEEN {WHOLE_FIRST} AND {WHOLE_LAST}"""


def _staffing_sums(periods: str) -> str:
    return f"""SELECT w.from_date, w.to_date, (SELECT count(*) FROM possible p WHERE p.date {INSIDE}) * CAST(7.5 AS DOUBLE) AS available,
        s.b * CAST(7.5 AS DOUBLE) AS b, s.n * CAST(7.5 AS DOUBLE) AS n, s.u * CAST(7.5 AS DOUBLE) AS u
        FROM {periods} w LEFT JOIN (SELECT w.from_date, count(*) FILTER (billable = 'billable') AS b,
          count(*) FILTER (billable = 'nonbillable') AS n, count(*) FILTER (billable = 'unavailable') AS u
          FROM st x JOIN {periods} w ON x.date {INSIDE} GROUP BY 1) s ON s.from_date = w.from_date"""


_SQL["d23_accumulated_staffing_hours"] = f"""SELECT from_date, to_date, available AS available_hours, b AS billable_hours,
    n AS nonbillable_hours, u AS unavailable_hours FROM ({_staffing_sums('months')})"""


def _billed(periods: str) -> str:
    return f"""SELECT w.from_date, w.to_date, k.n * CAST(7.5 AS DOUBLE) - t.u / 60.0 AS available, t.b / 60.0 AS billable
        FROM {periods} w
        JOIN (SELECT w.from_date, sum(minutes) FILTER (billable = 'billable') AS b, sum(minutes) FILTER (billable = 'unavailable') AS u,
            count(*) FILTER (billable = 'billable') AS rows FROM te x JOIN {periods} w ON x.date {INSIDE} GROUP BY 1) t
          ON t.from_date = w.from_date AND t.rows > 0
        LEFT JOIN (SELECT w.from_date, count(*) AS n FROM {periods} w JOIN employees e ON true
            JOIN workdays d ON d.date BETWEEN greatest(w.from_date, e.doe) AND least(e.term, w.to_date) GROUP BY 1) k
          ON k.from_date = w.from_date"""


PARTS["named_weeks"] = f"""SELECT y AS year, w AS week, {monday('y', 'w')} AS from_date, {monday('y', 'w')} + 6 AS to_date FROM (
    SELECT CAST(year(d) AS INTEGER) AS y, CAST(week(d) AS INTEGER) AS w
    FROM generate_series(CAST({MIXED_FIRST} AS TIMESTAMP), CAST({MIXED_LAST} AS TIMESTAMP), INTERVAL 7 DAY) g(d))"""
PARTS["distinct_weeks"] = "SELECT DISTINCT from_date, to_date FROM named_weeks"
_SQL["d24_staffing_and_billing_overview"] = f"""WITH planned_sums AS ({_staffing_sums('distinct_weeks')}), billed AS ({_billed('distinct_weeks')})
    SELECT w.year, w.week, w.from_date, w.to_date, p.available AS available_hours, p.b AS billable_hours, p.b / p.available * 100 AS planned_fg,
      a.available AS actual_available_hours, a.billable AS actual_billable_hours, a.billable / a.available * 100 AS actual_fg,
      a.available - p.available AS deviation_available_hours, a.billable - p.b AS deviation_billable_hours,
      (a.billable - p.b) / p.available * 100 AS deviation_fg
    FROM named_weeks w JOIN planned_sums p ON p.from_date = w.from_date JOIN billed a ON a.from_date = w.from_date"""

# E

_SQL["e1_fg"] = f"SELECT from_date, to_date, billable / available * 100 AS fg FROM ({_billed('months')})"
_SQL["e2_kpi_fg"] = f"SELECT from_date, to_date, billable / available * 100 AS fg FROM ({_billed('halfyears')})"
_SQL["e3_kpi_product_development"] = f"""SELECT w.from_date, w.to_date, coalesce(sum(t.minutes), 0) / 60.0 AS payload
    FROM halfyears w LEFT JOIN te t ON t.date {INSIDE} AND t.deductable GROUP BY 1, 2"""
_BUSINESS = """((SELECT count(*) FROM employees e JOIN workdays k ON k.date BETWEEN greatest(w.from_date, e.doe) AND least(e.term, w.to_date)) * CAST(7.5 AS DOUBLE))"""
_SQL["e4_kpi_sick"] = f"""SELECT w.from_date, w.to_date,
    (SELECT sum(minutes) FROM time_entry t WHERE t.project = 'SYK1000' AND t.date {INSIDE}) / 60.0 / {_BUSINESS} AS payload FROM halfyears w"""


def _economics(periods: str, fan_out: bool) -> str:
    """Sums per invoice and period; joined row by row for the fanned-out form."""
    if fan_out:
        invoices = """SELECT i.id, i.project, i.date, i.status, i.minutes, i.amount, w.minutes AS wm, o.amount AS om, s.amount AS sm
            FROM invoice_balance i LEFT JOIN write_off w ON w.invoice_balance = i.id
            LEFT JOIN expense o ON o.invoice_balance = i.id AND o.type = 'other'
            LEFT JOIN expense s ON s.invoice_balance = i.id AND s.type = 'subcontractor'"""
    else:
        invoices = """SELECT i.id, i.project, i.date, i.status, i.minutes, i.amount,
            (SELECT sum(w.minutes) FROM write_off w WHERE w.invoice_balance = i.id) AS wm,
            (SELECT sum(o.amount) FROM expense o WHERE o.invoice_balance = i.id AND o.type = 'other') AS om,
            (SELECT sum(s.amount) FROM expense s WHERE s.invoice_balance = i.id AND s.type = 'subcontractor') AS sm
            FROM invoice_balance i"""
    return f"""invoices AS ({invoices}),
      economics AS (SELECT p.id, w.from_date, w.to_date, i.status, i.minutes, i.amount, i.wm, i.om, i.sm, t.entered
        FROM projects p CROSS JOIN {periods} w
        LEFT JOIN (SELECT x.project, v.from_date, x.status, x.minutes, x.amount, sum(wm) AS wm, sum(om) AS om, sum(sm) AS sm
            FROM invoices x JOIN {periods} v ON x.date BETWEEN v.from_date AND v.to_date GROUP BY ALL) i
          ON i.project = p.id AND i.from_date = w.from_date
        LEFT JOIN (SELECT x.project, v.from_date, sum(x.minutes) AS entered FROM time_entry x JOIN {periods} v
            ON x.date BETWEEN v.from_date AND v.to_date GROUP BY 1, 2) t ON t.project = p.id AND t.from_date = w.from_date
        WHERE p.billable = 'billable')"""


_SQL["e5_kpi_ul"] = f"""WITH {_economics('halfyears', True)}
    SELECT from_date, to_date, CAST(sum(sm) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS payload FROM economics GROUP BY 1, 2"""
_SQL["e6_sum_business_hours"] = f"SELECT w.from_date, w.to_date, {_BUSINESS} AS sum_business_hours FROM months w"
_SQL["e7_accumulated_billed_hours"] = f"SELECT from_date, to_date, available AS sum_available_hours, billable AS sum_billable_hours FROM ({_billed('months')})"
_SQL["e8_kpi_prodev"] = f"""SELECT w.from_date, w.to_date, h / available * 100 AS percent, h AS project_hours, available AS available_hours
    FROM (SELECT b.*, (SELECT sum(minutes) FROM time_entry t WHERE t.project = 'FAG1000' AND t.date BETWEEN b.from_date AND b.to_date) / 60.0 AS h
      FROM ({_billed('halfyears')}) b) w"""
# Month steps that keep a cut-off day of month: the smallest last day of month seen so far.
PARTS["steps"] = f"""SELECT d - 84 AS from_date, d AS to_date FROM (
    SELECT make_date(year(m), month(m), min(least(31, day(last_day(m)))) OVER (ORDER BY m)) AS d
    FROM generate_series(TIMESTAMP '1995-03-01', date_trunc('month', {END}), INTERVAL 1 MONTH) g(m)) WHERE d <= {END}"""
_SQL["e9_kpi_fgdev"] = f"""SELECT w.from_date, w.to_date, p AS planned_billable_hours, billable AS achieved_billable_hours, (billable - p) / billable * 100 AS deviation
    FROM (SELECT b.*, (SELECT count(*) FROM st s WHERE s.billable = 'billable' AND s.date BETWEEN b.from_date AND b.to_date) * CAST(7.5 AS DOUBLE) AS p
      FROM ({_billed('steps')}) b) w"""
_SQL["e10_kpi_visibility"] = f"""SELECT week, year, {monday('year', 'week')} AS week_date, billable_hours / CAST(available_hours AS DOUBLE) * 100 AS percent
    FROM reporting_visibility WHERE {monday('year', 'week')} BETWEEN {START} AND {END}"""


def _reconciled(periods: str) -> str:
    return f"""SELECT w.from_date, w.to_date, sum(o.minutes) / 60.0 AS write_off, CAST(sum(i.minutes) AS BIGINT) // 60 AS hours,
        CAST(sum(i.amount) AS DOUBLE) AS amount, CAST(sum(i.amount) - sum(coalesce(e.sub, 0)) - sum(coalesce(e.oth, 0)) AS DOUBLE) AS amount_net,
        count(i.id) AS count, CAST(sum(CASE WHEN e.id IS NOT NULL THEN i.minutes WHEN i.id IS NOT NULL THEN 0 END) AS BIGINT) // 60 AS subcontractor_hours,
        CAST(CASE WHEN count(i.id) > 0 THEN sum(coalesce(e.sub, 0)) END AS DOUBLE) AS subcontractor_expense,
        CAST(CASE WHEN count(i.id) > 0 THEN sum(coalesce(e.oth, 0)) END AS DOUBLE) AS other_expense
        FROM {periods} w LEFT JOIN invoice_balance i ON i.date {INSIDE}
        LEFT JOIN (SELECT invoice_balance AS id, sum(amount) FILTER (type = 'subcontractor') AS sub, sum(amount) FILTER (type = 'other') AS oth
            FROM expense GROUP BY 1) e ON e.id = i.id
        LEFT JOIN (SELECT invoice_balance AS id, sum(minutes) AS minutes FROM write_off GROUP BY 1) o ON o.id = i.id GROUP BY 1, 2"""


def _ot(periods: str) -> str:
    return f"""SELECT r.from_date, r.to_date, r.write_off, r.hours AS invoice_hours, r.amount AS amount_gross, r.amount_net, r.subcontractor_hours,
        r.subcontractor_expense, b.billable AS billable_hours, r.amount_net / b.billable AS ot
        FROM ({_reconciled(periods)}) r JOIN ({_billed(periods)}) b ON b.from_date = r.from_date AND b.to_date = r.to_date"""


# Windows of one year share their start, so the sums below are keyed by the end as well.
_SQL["e11_accumulated_reconciliation"] = _reconciled("months")
_SQL["e12_ot"] = _ot("months")
_SQL["e13_ot_rolling"] = f"SELECT * EXCLUDE (from_date, to_date), from_date AS from_d, to_date AS to_d FROM ({_ot('halfyears')})"
PARTS["year_to_date"] = f"""SELECT greatest(make_date(year(m), 1, 1), {START}) AS from_date, last_day(m) AS to_date
    FROM generate_series(date_trunc('month', {START}), date_trunc('month', {END}), INTERVAL 1 MONTH) g(m)"""
_BILLED_BY_END = _billed("year_to_date").replace("SELECT w.from_date, sum", "SELECT w.to_date AS from_date, sum").replace(
    "SELECT w.from_date, count", "SELECT w.to_date AS from_date, count"
).replace("t.from_date = w.from_date", "t.from_date = w.to_date").replace("k.from_date = w.from_date", "k.from_date = w.to_date")
_SQL["e14_kpi_accumulated_fg"] = f"SELECT from_date AS sum_start_date, to_date AS sum_end_date, billable / available * 100 AS summed_fg FROM ({_BILLED_BY_END})"
_SQL["e15_kpi_accumulated_ot"] = f"""SELECT r.from_date AS sum_start_date, r.to_date AS sum_end_date, r.amount_net / b.billable AS summed_ot
    FROM ({_reconciled('year_to_date')}) r JOIN ({_BILLED_BY_END}) b ON b.to_date = r.to_date"""
PARTS["alone"] = f"""SELECT from_date, to_date, customer AS customer_id, min(employee) AS employee_count FROM (
    SELECT w.from_date, w.to_date, t.customer, t.employee, sum(t.minutes) FILTER (t.billable = 'billable') AS b,
      coalesce(sum(t.minutes) FILTER (t.billable = 'unavailable'), 0) AS u,
      (SELECT count(*) FROM workdays k WHERE k.date BETWEEN greatest(e.doe, w.from_date) AND least(e.term, w.to_date)) * 7.5 AS possible
    FROM te t JOIN employees e ON e.id = t.employee JOIN bimonths w ON t.date {INSIDE}
    GROUP BY w.from_date, w.to_date, t.customer, t.employee, e.doe, e.term)
    WHERE b > 0 AND b / 60.0 / nullif(possible - u / 60.0, 0) > 0.5 GROUP BY 1, 2, 3 HAVING count(*) = 1"""
_SQL["e16_unaccompanied_customer_involvement_in_period"] = "SELECT from_date, to_date, customer_id, CAST(employee_count AS INTEGER) AS employee_count FROM alone"
_SQL["e17_unaccompanied_customer_involvement_kpi"] = """SELECT w.from_date, w.to_date,
    count(*) / CAST((SELECT count(*) FROM employees e WHERE e.permanent AND e.doe <= w.to_date AND (e.term IS NULL OR e.term >= w.from_date)) AS DOUBLE) AS percent
    FROM alone w GROUP BY 1, 2"""
_SQL["e18_monthly_balance_summary"] = f"""WITH {_economics('months', True)}
    SELECT from_date, to_date, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS invoice_money, CAST(coalesce(sum(minutes), 0) AS DOUBLE) AS invoice_balance_minutes,
      CAST(coalesce(sum(entered), 0) AS DOUBLE) AS time_entry_minutes, CAST(coalesce(sum(wm), 0) AS DOUBLE) AS write_off_minutes,
      CAST(coalesce(sum(om), 0) AS DOUBLE) AS expense_money, CAST(coalesce(sum(sm), 0) AS DOUBLE) AS subcontractor_money FROM economics GROUP BY 1, 2"""
for _key, _fan in [("e19_hours_per_project", True), ("e19_hours_per_project_counted_once", False)]:
    _SQL[_key] = f"""WITH {_economics('years_back', _fan)}
        SELECT id AS project, status, CAST(coalesce(entered, 0) AS BIGINT) AS time_entry_minutes, coalesce(minutes, 0) AS invoice_balance_minutes,
          CAST(coalesce(amount, 0) AS DOUBLE) AS invoice_balance_money, CAST(coalesce(wm, 0) AS BIGINT) AS write_off_minutes,
          CAST(coalesce(om, 0) AS DOUBLE) AS expense_money, CAST(coalesce(sm, 0) AS DOUBLE) AS subcontractor_money,
          from_date AS start_date, to_date AS end_date FROM economics"""

for _key in (
    "b6_employees_in_dates",
    "c1_accumulated_hours_for_employee",
    "c10_unregistered_days",
    "c11_time_tracking_status",
    "d10_availability_percentage",
    "e7_accumulated_billed_hours",
    "e19_hours_per_project",
):
    _SQL[f"{_key}_period_table"] = _SQL[_key]

# F

_SQL["f1a_employee_years_v1"] = f"""SELECT id AS employee, CAST(year(d) AS INTEGER) AS year
    FROM employees, unnest(generate_series(CAST(doe AS TIMESTAMP), CAST({LAST_DAY} AS TIMESTAMP), INTERVAL 1 YEAR)) u(d)"""
_SQL["f1b_employee_years_v2"] = f"""SELECT id AS employee, CAST(year(d) AS INTEGER) AS year
    FROM employees, unnest(generate_series(CAST(doe AS TIMESTAMP), CAST(coalesce(term, {LAST_DAY}) AS TIMESTAMP), INTERVAL 1 YEAR)) u(d)"""
PARTS["years"] = f"""SELECT id AS employee, CAST(y AS INTEGER) AS year
    FROM employees, unnest(generate_series(year(doe), year(coalesce(term, {LAST_DAY})))) u(y)"""
_SQL["f1c_employee_years"] = "SELECT employee, year FROM years"
_EARNT = "coalesce(v.days_earnt, 25) AS days_earnt"
_SPENT = """coalesce((SELECT sum(minutes) / 60.0 / 7.5 FROM time_entry t
    WHERE t.employee = y.employee AND year(t.date) = y.year AND t.project = 'FER1000'), 0) AS days_spent"""
_JOINED = "FROM years y LEFT JOIN vacation_days v ON v.employee_id = y.employee AND v.year = y.year"
_SQL["f2_vacation_days_earnt"] = f"SELECT y.employee, y.year, {_EARNT} {_JOINED}"
_SQL["f3_vacation_days_spent"] = f"SELECT y.employee, y.year, {_SPENT} FROM years y"
_SQL["f4_vacation_days_by_year"] = f"SELECT y.employee, y.year, {_EARNT}, {_SPENT} {_JOINED}"

# G

_PLAIN = "SELECT '{part}' AS part, CAST(NULL AS INTEGER) AS seq, employee, project, date, percentage FROM {rows}"
_BACK = "SELECT 'returned' AS part, seq, employee, project, date, CAST(NULL AS INTEGER) AS percentage FROM {rows}"
_ABSENCE_ROWS = "(SELECT employee_id AS employee, reason AS project, date, percentage FROM absence)"
_REJECTED = f"""SELECT 'rejected' AS part, seq, employee, project, start_date AS date, CAST(NULL AS INTEGER) AS percentage
    FROM orders_in WHERE project IN {REASONS}"""
_FIRST = "QUALIFY row_number() OVER (PARTITION BY employee, project, date ORDER BY seq) = 1"

_SQL["g1_add_staffing_in_period"] = f"""WITH wanted AS (
      SELECT * FROM (SELECT o.seq, o.employee, o.project, d.date, o.percentage FROM orders_in o JOIN days d ON isodow(d.date) < 6
        AND d.date BETWEEN o.start_date AND greatest(o.start_date, o.end_date)) {_FIRST}),
    new_staffing AS (SELECT * FROM wanted a WHERE project NOT IN {REASONS} AND NOT EXISTS (
      SELECT 1 FROM staffing s WHERE s.employee = a.employee AND s.project = a.project AND s.date = a.date)),
    new_absence AS (SELECT * FROM wanted a WHERE project IN {REASONS} AND NOT EXISTS (
      SELECT 1 FROM absence s WHERE s.employee_id = a.employee AND s.reason = a.project AND s.date = a.date))
    {_PLAIN.format(part='staffing', rows='staffing')} UNION ALL {_PLAIN.format(part='staffing', rows='new_staffing')}
    UNION ALL {_PLAIN.format(part='absence', rows=_ABSENCE_ROWS)} UNION ALL {_PLAIN.format(part='absence', rows='new_absence')}
    UNION ALL {_BACK.format(rows='new_staffing')} UNION ALL {_BACK.format(rows='new_absence')}"""
# Days of each request by themselves, without a range join.
_ASKED = f"""asked AS MATERIALIZED (SELECT seq, employee, project, percentage, CAST(d AS DATE) AS date, isodow(d) < 6 AS weekday,
      isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT date FROM holidays) AS workday, project IN {REASONS} AS reason
      FROM orders_in, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) u(d))"""
_ON_KEY = "h.employee = s.employee AND h.project = s.project AND h.date = s.date"
_SQL["g2_remove_staffing_in_period"] = f"""WITH {_ASKED}, hit AS MATERIALIZED (SELECT min(seq) AS seq, employee, project, date, reason
      FROM asked WHERE weekday GROUP BY employee, project, date, reason)
    {_PLAIN.format(part='staffing', rows='staffing')} s ANTI JOIN (SELECT * FROM hit WHERE NOT reason) h USING (employee, project, date)
    UNION ALL {_PLAIN.format(part='absence', rows=_ABSENCE_ROWS)} s ANTI JOIN (SELECT * FROM hit WHERE reason) h USING (employee, project, date)
    UNION ALL {_BACK.format(rows='(SELECT * FROM hit WHERE NOT reason)')} h SEMI JOIN staffing s USING (employee, project, date)
    UNION ALL {_BACK.format(rows='(SELECT * FROM hit WHERE reason)')} h SEMI JOIN {_ABSENCE_ROWS} s USING (employee, project, date)"""
_SQL["g3_insert_staffing"] = f"""WITH new_rows AS (SELECT * FROM (SELECT * FROM asked_days WHERE workday AND project NOT IN {REASONS} {_FIRST}) a
      WHERE NOT EXISTS (SELECT 1 FROM staffing s WHERE s.employee = a.employee AND s.project = a.project AND s.date = a.date))
    {_PLAIN.format(part='staffing', rows='staffing')} UNION ALL {_PLAIN.format(part='staffing', rows='new_rows')}
    UNION ALL {_BACK.format(rows='new_rows')} UNION ALL {_REJECTED}"""
_SQL["g4_upsert_staffing"] = f"""WITH {_ASKED}, accepted AS MATERIALIZED (SELECT * FROM asked WHERE NOT reason),
    last_one AS MATERIALIZED (SELECT employee, project, date, workday, max(seq) AS seq, arg_max(percentage, seq) AS percentage
      FROM accepted GROUP BY employee, project, date, workday)
    {_PLAIN.format(part='staffing', rows='staffing')} s ANTI JOIN last_one a USING (employee, project, date)
    UNION ALL {_PLAIN.format(part='staffing', rows='last_one')} WHERE workday
    UNION ALL {_BACK.format(rows='accepted')} WHERE workday UNION ALL {_REJECTED}"""
_SQL["g5_remove_staffing_range"] = f"""WITH hit AS (SELECT min(o.seq) AS seq, s.employee, s.project, s.date FROM staffing s JOIN orders_in o
      ON o.employee = s.employee AND o.project = s.project AND s.date >= o.start_date AND (o.percentage <> 80 OR s.date <= o.end_date) GROUP BY 2, 3, 4)
    {_PLAIN.format(part='staffing', rows='staffing')} s WHERE NOT EXISTS (
      SELECT 1 FROM hit h WHERE h.employee = s.employee AND h.project = s.project AND h.date = s.date)
    UNION ALL {_BACK.format(rows='hit')}"""
_SQL["g6_add_staffing_week"] = f"""WITH asked AS (SELECT *, {monday('year', 'week')} AS m,
      sum(days) OVER (PARTITION BY employee, {monday('year', 'week')} ORDER BY seq) AS upto FROM orders_in),
    open_days AS (SELECT g.employee, g.m, k.date, row_number() OVER (PARTITION BY g.employee, g.m ORDER BY k.date) AS rank
      FROM (SELECT DISTINCT employee, m FROM asked) g JOIN workdays k ON k.date BETWEEN g.m AND g.m + 6
      WHERE NOT EXISTS (SELECT 1 FROM staffing s WHERE s.employee = g.employee AND s.date = k.date)
        AND NOT EXISTS (SELECT 1 FROM absence a WHERE a.employee_id = g.employee AND a.date = k.date)),
    given AS (SELECT a.seq, a.employee, a.project, f.date, 100 AS percentage FROM asked a JOIN open_days f
      ON f.employee = a.employee AND f.m = a.m AND f.rank > a.upto - a.days AND f.rank <= a.upto)
    {_PLAIN.format(part='staffing', rows='staffing')} UNION ALL {_PLAIN.format(part='staffing', rows='given')}
    UNION ALL {_BACK.format(rows='given')}"""
_SQL["g7_remove_staffing_week"] = f"""WITH numbered AS (SELECT *,
      row_number() OVER (PARTITION BY employee, project, year(date), week(date) ORDER BY date DESC) AS rank,
      max(percentage // 50) OVER (PARTITION BY employee, project, year(date), week(date)) AS n,
      max(day(date)) OVER (PARTITION BY employee, project, year(date), week(date)) AS last FROM staffing),
    ranked AS (SELECT *, CAST(2 * last + CASE WHEN rank > n THEN 1 ELSE 0 END AS INTEGER) AS seq FROM numbered)
    {_PLAIN.format(part='staffing', rows='ranked')} WHERE rank > n + 1
    UNION ALL {_BACK.format(rows='ranked')} WHERE rank <= n + 1"""
_SQL["g8_fix_staffing_on_weekends_and_holidays"] = """WITH bad AS (SELECT s.* FROM staffing s WHERE isodow(date) > 5 OR date IN (SELECT date FROM holidays)),
    per_week AS (SELECT employee, project, CAST(year(date) AS INTEGER) AS year, CAST(week(date) AS INTEGER) AS week, CAST(count(*) AS INTEGER) AS n FROM bad GROUP BY ALL),
    open_days AS (SELECT *, row_number() OVER (PARTITION BY employee, year, week ORDER BY date) AS rank FROM free)
    SELECT employee, project, date, percentage, CAST(NULL AS INTEGER) AS year, CAST(NULL AS INTEGER) AS week, CAST(NULL AS INTEGER) AS count FROM (
      SELECT employee, project, date, percentage FROM staffing WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM holidays)
      UNION ALL SELECT DISTINCT w.employee, w.project, f.date, 100 FROM per_week w JOIN open_days f
        ON f.employee = w.employee AND f.year = w.year AND f.week = w.week AND f.rank <= w.n)
    UNION ALL SELECT employee, project, NULL, NULL, year, week, n FROM per_week w
      WHERE NOT EXISTS (SELECT 1 FROM open_days f WHERE f.employee = w.employee AND f.year = w.year AND f.week = w.week)"""
_SQL["g9_lock_employee_hours"] = """WITH touched AS (SELECT DISTINCT o.seq, t.employee, o.date AS commit_date FROM orders_in o JOIN time_entry t
      ON t.project = o.project AND t.date BETWEEN o.start_date AND o.start_date + 30),
    known AS (SELECT employee, arg_max(commit_date, created) AS latest FROM timelock_events GROUP BY 1),
    chained AS (SELECT t.*, coalesce(lag(t.commit_date) OVER (PARTITION BY t.employee ORDER BY t.seq), k.latest) AS before
      FROM touched t LEFT JOIN known k ON k.employee = t.employee),
    fresh AS (SELECT seq, employee, commit_date, 0 AS creator FROM chained WHERE before IS DISTINCT FROM commit_date)
    SELECT *, CAST(NULL AS BIGINT) AS n FROM fresh UNION ALL
    SELECT NULL, employee, commit_date, creator, count(*) FROM (SELECT employee, commit_date, creator FROM fresh
      UNION ALL SELECT employee, commit_date, creator FROM timelock_events) GROUP BY employee, commit_date, creator"""
_SQL["g10_timelock_view"] = """SELECT id, created, creator, employee, commit_date FROM timelock_events
    QUALIFY row_number() OVER (PARTITION BY employee ORDER BY created DESC, id DESC) = 1"""


def _lacking(*columns: str) -> str:
    """Requests, of which some lack a value."""
    return f"SELECT * REPLACE ({', '.join(f'CASE WHEN seq % 89 <> 0 THEN {c} END AS {c}' for c in columns)}) FROM orders_in"


def _upserted(lacks: str, values: tuple[str, ...], key: str, extra: str = "", kind: str = "NULL") -> str:
    """New invoices, what every request reports, and the rejected requests. ``key`` is the id reported."""

    def value(column: str, default: str) -> str:
        if column in values:
            return f"CASE WHEN c.project IS NOT NULL THEN c.{column} ELSE i.{column} END"
        return f"coalesce(i.{column}, {default})"

    return f"""WITH all_asked AS MATERIALIZED ({_lacking(lacks)}), asked AS (SELECT * FROM all_asked WHERE {lacks} IS NOT NULL),
        merged AS (SELECT coalesce(i.project, c.project) AS project, coalesce(i.date, c.date) AS date,
          coalesce(i.id, sha256(c.project || '|' || c.date)) AS id, CAST({value('amount', '0')} AS DOUBLE) AS amount,
          {value('minutes', '0')} AS minutes, {value('status', "'not_done'")} AS status, coalesce(i.date, DATE '2001-11-05') AS created
          FROM invoice_balance i FULL JOIN (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY project, date ORDER BY seq DESC) = 1) c
            ON c.project = i.project AND c.date = i.date)
        SELECT 'invoices' AS part, CAST(NULL AS INTEGER) AS seq, project, date, id, amount, CAST(minutes AS INTEGER) AS minutes, status,
          CAST(NULL AS VARCHAR) AS type, created FROM merged
        UNION ALL SELECT 'returned', a.seq, a.project, a.date, {key}, NULL, NULL, NULL, {kind}, NULL
          FROM asked a JOIN merged m ON m.project = a.project AND m.date = a.date
        UNION ALL SELECT 'rejected', seq, project, date, NULL, {'CAST(amount AS DOUBLE)' if 'amount' in (*values, lacks) else 'NULL'},
          {'minutes' if 'minutes' in (*values, lacks) else 'NULL'}, {'status' if 'status' in (*values, lacks) else 'NULL'}, {kind.replace('a.', '')}, NULL
          FROM all_asked WHERE {lacks} IS NULL
        {extra}"""


_SQL["g11_upsert_invoice_balance"] = _upserted("minutes", ("amount", "minutes"), "m.id")
_SQL["g12_upsert_invoice_status"] = _upserted("status", ("status",), "m.id")
_SQL["g13_upsert_expense"] = _upserted("amount", (), "sha256(m.id || '|' || a.type)", """
    UNION ALL SELECT 'expenses', NULL, i.project, i.date, NULL, CAST(e.amount AS DOUBLE), NULL, NULL, e.type, e.created
      FROM expense e JOIN invoice_balance i ON i.id = e.invoice_balance
      WHERE NOT EXISTS (SELECT 1 FROM asked n WHERE n.project = i.project AND n.date = i.date AND n.type = e.type)
    UNION ALL SELECT 'expenses', NULL, project, date, NULL, CAST(arg_max(amount, seq) AS DOUBLE), NULL, NULL, type, DATE '2001-11-05'
      FROM asked GROUP BY project, date, type""", "a.type")
_SQL["g14_upsert_write_off"] = _upserted("minutes", (), "sha256('write_off|' || m.id)", """
    UNION ALL SELECT 'write_offs', NULL, i.project, i.date, NULL, NULL, e.minutes, NULL, NULL, e.created
      FROM write_off e JOIN invoice_balance i ON i.id = e.invoice_balance
      WHERE NOT EXISTS (SELECT 1 FROM asked n WHERE n.project = i.project AND n.date = i.date)
    UNION ALL SELECT 'write_offs', NULL, project, date, NULL, NULL, arg_max(minutes, seq), NULL, NULL, DATE '2001-11-05'
      FROM asked GROUP BY project, date""")


def _split(condition: str, percentage: str = "percentage") -> str:
    return f"""WITH moving AS (SELECT * REPLACE ({percentage} AS percentage) FROM before_split b WHERE project IN {REASONS} AND {condition} AND NOT EXISTS (
          SELECT 1 FROM absence a WHERE a.employee_id = b.employee AND a.reason = b.project AND a.date = b.date))
        {_PLAIN.format(part='staffing', rows='before_split')} WHERE project NOT IN {REASONS}
        UNION ALL {_PLAIN.format(part='absence', rows=_ABSENCE_ROWS)} x UNION ALL {_PLAIN.format(part='absence', rows='moving')}
        UNION ALL SELECT 'returned', CAST(NULL AS INTEGER), employee, project, date, CAST(NULL AS INTEGER) FROM moving"""


_SQL["g15_move_absence_out_of_staffing"] = _split("true")
_SQL["g16_first_absence_split"] = _split("date NOT IN (SELECT date FROM holidays)", "100")
_SQL["g17_billable_flag_to_class"] = """SELECT id, CASE billable WHEN 'billable' THEN 'billable' ELSE 'nonbillable' END AS billable,
    billable = 'billable' AS flag FROM projects"""
_SQL["g18_rename_keys"] = """WITH mapping AS (SELECT id AS old_id, CASE WHEN id LIKE '%3' THEN 'X-3'
        WHEN id LIKE 'P%5' THEN left(id, 8) || '6' ELSE 'X-' || id END AS new_id FROM projects WHERE NOT active
      UNION ALL SELECT id, 'Y-' || id FROM projects WHERE NOT active AND id LIKE '%7'),
    ok AS (SELECT * FROM mapping m WHERE (SELECT count(*) FROM mapping x WHERE x.old_id = m.old_id) = 1
      AND (SELECT count(*) FROM mapping x WHERE x.new_id = m.new_id) = 1 AND new_id NOT IN (SELECT id FROM projects)
      AND old_id NOT IN (SELECT project FROM invoice_balance)),
    new_of AS (SELECT p.id, coalesce(o.new_id, p.id) AS project FROM projects p LEFT JOIN ok o ON o.old_id = p.id)
    SELECT 'projects' AS part, project, CAST(1 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS new_id FROM new_of
    UNION ALL SELECT 'time_entry', o.project, count(*), NULL FROM new_of o JOIN time_entry t ON t.project = o.id GROUP BY 2
    UNION ALL SELECT 'staffing', o.project, count(*), NULL FROM new_of o JOIN staffing t ON t.project = o.id GROUP BY 2
    UNION ALL SELECT 'returned', old_id, 1, new_id FROM ok
    UNION ALL SELECT 'rejected', old_id, 1, new_id FROM mapping WHERE old_id NOT IN (SELECT old_id FROM ok)"""
_SQL["g19_write_authorisation_split"] = """WITH marked AS (SELECT t.employee, coalesce(a.id IN (SELECT employee_id FROM employee_role), false) AS admin,
      coalesce(a.id = t.employee, false) AS own
      FROM time_entry t LEFT JOIN employees a ON a.id = t.minutes % 7)
    SELECT employee, count(*) AS n, CASE WHEN admin OR own THEN 'allowed' ELSE 'rejected' END AS outcome FROM marked GROUP BY ALL
    UNION ALL SELECT employee, count(*), 'allowed to administrators' FROM marked WHERE admin GROUP BY 1"""
_OF = "FROM orders WHERE o_orderkey % 5 = 0"
_DAY, _TEN = "CAST(o_orderdate AS DATE)", "CAST(o_custkey % 10 AS INTEGER)"
PARTS |= {
    "talks": f"SELECT CAST(o_orderkey % 3000 AS INTEGER) AS id, o_custkey % 120 AS employee {_OF}",
    "project_sdg_events": f"""SELECT o_orderkey AS event_id, {booked('(o_orderkey % 200)')} AS project,
        CASE WHEN o_orderkey % 20 <> 0 THEN 1 END AS goal {_OF}""",
    "time_entry_comments": f"""SELECT o_orderkey AS id, o_orderkey % 3 AS employee, o_custkey % 130 AS creator,
        {booked('(o_orderkey % 100)')} AS project, make_date(year(o_orderdate), 1, 1) AS date {_OF}""",
    "invoice_lock_events": f"""SELECT o_orderkey AS id, {booked('(o_orderkey % 200)')} AS project_id,
        CASE WHEN o_orderkey % 89 <> 0 THEN {_DAY} END AS commit_date {_OF}""",
    "ranked_matchups": f"""SELECT o_orderkey AS id, 'g' || (o_custkey % 27) AS game_id, {_TEN} AS user1_id,
        CAST(o_orderkey // 5 % 10 AS INTEGER) AS user2_id, o_orderstatus {_OF}""",
    "employee_settings": """SELECT id AS employee_id, id % 7 = 0 AS unknown FROM employees
        UNION ALL SELECT id, id % 7 = 0 FROM employees WHERE id % 4 = 0""",
    "employee_task": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, 't' || (o_custkey % 30) AS task_id,
        CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 140 END AS completed_by_id {_OF}""",
    "employee_task_comments": f"SELECT CAST(o_orderkey + 25 AS VARCHAR) AS employee_task_id {_OF}",
    "notification": f"SELECT o_custkey % 110 AS employee_id {_OF}",
    "phase": "SELECT 'p' || id AS id, 's' || (CAST(id AS INTEGER) % 6) AS process_template_id FROM customers",
    "process_template": "SELECT 's' || id AS slug FROM customers WHERE CAST(id AS INTEGER) < 5",
    "profession": "SELECT 'q' || (CAST(id AS INTEGER) % 20) AS slug, 'n' || (CAST(id AS INTEGER) % 12) AS title FROM customers",
    "profession_task": "SELECT 'q' || (CAST(id AS INTEGER) % 22) AS profession_id, 't' || (CAST(id AS INTEGER) % 23) AS task_id FROM customers",
    "task": """SELECT 't' || id AS id, 'p' || (CAST(id AS INTEGER) + 1) AS phase_id, CAST(id AS INTEGER) * 9 AS responsible_id,
        CAST(id AS INTEGER) AS number FROM customers""",
}


def _twice(table: str, rule: str, key: str) -> str:
    return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, concat_ws('|', {key}) AS key FROM {table} GROUP BY {key} HAVING count(*) > 1"


def _orphan(table: str, column: str, parent: str, key: str = "id") -> str:
    return f"""SELECT DISTINCT '{table}' AS "table", 'foreign key: {column}' AS rule, CAST({column} AS VARCHAR) AS key FROM {table}
        WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"""


def _wrong(table: str, rule: str, key: str, condition: str) -> str:
    return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, CAST({key} AS VARCHAR) AS key FROM {table} WHERE {condition}"


_SQL["g20_table_contract_report"] = """WITH open_projects AS (SELECT * FROM projects WHERE active),
    wrong AS (SELECT employee AS employee_id, date, project AS reason, employee || '|' || project || '|' || date AS key FROM time_entry)
    SELECT 'absence' AS "table", 'check: absence reason' AS rule, key FROM wrong WHERE reason NOT IN {reasons}
    UNION ALL SELECT 'absence', 'check: not on a holiday', key FROM wrong WHERE date IN (SELECT date FROM holidays)
    UNION ALL SELECT 'absence', 'primary key: employee_id, reason, date', key FROM wrong GROUP BY key HAVING count(*) > 1
    UNION ALL {others}""".format(
    reasons=REASONS,
    others=" UNION ALL ".join([
        _twice("time_entry", "primary key: id", "id"),
        _orphan("time_entry", "project", "open_projects"),
        _orphan("staffing", "project", "open_projects"),
        _orphan("invoice_balance", "project", "open_projects"),
        _twice("talks", "primary key: id", "id"),
        _orphan("talks", "employee", "employees"),
        _wrong("project_sdg_events", "not null: goal", "event_id", "goal IS NULL"),
        _orphan("project_sdg_events", "project", "open_projects"),
        _twice("time_entry_comments", "unique: employee, project, date", "employee, project, date"),
        _orphan("time_entry_comments", "creator", "employees"),
        _orphan("time_entry_comments", "project", "open_projects"),
        _wrong("invoice_lock_events", "not null: commit_date", "id", "commit_date IS NULL"),
        _orphan("invoice_lock_events", "project_id", "open_projects"),
        _wrong("ranked_matchups", "allowed values: matchup_result", "id", "o_orderstatus NOT IN ('F', 'O')"),
        _wrong("ranked_matchups", "check: two players", "id", "user1_id = user2_id"),
        _orphan("ranked_matchups", "game_id", "(SELECT 'g' || id AS id FROM customers)"),
        _twice("employee_settings", "primary key: employee_id", "employee_id"),
        _wrong("employee_settings", "not null: hired", "employee_id", "unknown"),
        _orphan("employee_task", "task_id", "task"),
        _orphan("employee_task", "completed_by_id", "employees"),
        _orphan("employee_task_comments", "employee_task_id", "employee_task"),
        _orphan("notification", "employee_id", "employees"),
        _orphan("phase", "process_template_id", "process_template", "slug"),
        _twice("profession", "primary key: slug", "slug"),
        _twice("profession", "unique: title", "title"),
        _twice("profession_task", "primary key: profession_id, task_id", "profession_id, task_id"),
        _orphan("profession_task", "profession_id", "profession", "slug"),
        _orphan("task", "phase_id", "phase"),
        _orphan("task", "responsible_id", "employees"),
        _wrong("task", "allowed values: responsible_type", "id", "number % 3 = 2"),
    ]),
)
_SQL["g21_emoji_domain_check"] = """WITH characters AS (SELECT unnest(string_split(text, '')) AS value FROM documents),
    counted AS (SELECT unicode(value) AS c, count(*) AS n FROM characters GROUP BY 1),
    ranges AS (SELECT * FROM (VALUES (128, 687), (768, 1023), (1536, 1791), (3072, 3199), (7616, 7679), (7680, 7935), (8192, 8351),
      (8400, 8527), (8592, 9215), (9312, 9727), (9728, 10223), (10496, 10751), (11008, 11263), (11360, 11391), (11776, 11903),
      (12288, 12351), (42128, 42191), (57344, 63743), (65024, 65039), (65072, 65103), (126976, 127023), (127136, 127231),
      (127232, 128591), (128640, 128767), (129296, 129387), (129408, 129504)) v(lo, hi))
    SELECT CAST(c AS INTEGER) AS code_point, EXISTS (SELECT 1 FROM ranges WHERE c BETWEEN lo AND hi) AS is_emoji, n FROM counted"""

# The same answers by way of tables that are stored
for _key, _stored in [
    ("c12_time_tracking_status_with_staffing", "from_rollup"),
    ("e2_kpi_fg", "from_rollup"),
    ("g4_upsert_staffing", "stored_by_month"),
    ("g10_timelock_view", "merged"),
]:
    _SQL[f"{_key}_{_stored}"] = _SQL[_key]
