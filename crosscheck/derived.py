"""Domain tables derived from the driver's Parquet tables. The rules are listed in FIXTURES.md."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import Tables
from shiftledger.functions.codes import is_absence_reason
from shiftledger.operators.calendar import holidays_dimension

# Project codes given to the first part keys.
NAMED_CODES = (
    "FER1000", "SYK1000", "SYK1001", "SYK1002", "PER1000", "PER1001", "PER1002", "FAG1000", "ADM1003",
    "INT1000", "INT2000", "REK1000", "ADM1000", "SAL1000", "PER1003", "PER1005", "REK1010", "SYK1003",
)
SOURCES = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}
UNAVAILABLE_KEYS = (0, 1, 2, 3, 4, 5, 6, 14, 17)
NONBILLABLE_KEYS = (7, 8, 9, 10, 11, 12, 13, 15, 16)
HOLIDAYS = (dt.date(1994, 1, 1), dt.date(2002, 12, 31))


def project_code(key: Column) -> Column:
    """Project code of a part: the first eighteen have names."""
    names = F.array(*map(F.lit, NAMED_CODES))
    own = F.concat(F.lit("P"), F.lpad(key.cast("string"), 8, "0"))
    return F.when(key < len(NAMED_CODES), F.element_at(names, F.least(key, F.lit(17)).cast("int") + 1)).otherwise(own)


def booked_code(key: Column) -> Column:
    """Project that a fact row with this part or order key books on: one row in eleven or so lands on a
    named code, the others on the key's own project."""
    return project_code(F.when(key % 200 < len(NAMED_CODES), key % 200).otherwise(key))


_LOCAL: list[tempfile.TemporaryDirectory] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else, on one machine, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("stored tables need a folder that all machines share: set spark.checkpoint.dir")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="crosscheck-"))
        root = _LOCAL[0].name
    return f"{root.rstrip('/')}/crosscheck/{uuid.uuid4().hex}"


def derived_tables(spark: SparkSession, folder: str) -> Tables:
    @cache
    def source(name: str) -> DataFrame:
        return spark.read.schema(SOURCES[name]).parquet(f"{folder}/{name}.parquet")

    @cache
    def employees() -> DataFrame:
        key = F.col("s_suppkey")
        hired = F.date_add(F.lit(dt.date(1995, 1, 1)), (key * 37 % 700).cast("int"))
        left = F.date_add(F.lit(dt.date(1999, 1, 1)), (key * 53 % 700).cast("int"))
        return source("supplier").select(
            key.cast("int").alias("id"),
            F.concat(F.lit("E"), (key % 7).cast("string")).alias("first_name"),
            F.col("s_name").alias("last_name"),
            F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
            hired.alias("date_of_employment"),
            F.when(key % 5 == 0, left).alias("termination_date"),
            F.when(key % 4 == 0, "Annet").when(key % 4 == 1, "Konsulent").when(key % 4 == 2, "Designer").alias("role"),
            F.lit(None).cast("string").alias("image_url"),
            (key % 9 != 0).alias("has_permanent_position"),
            F.when(key % 3 == 0, F.lit("\U0001f600")).alias("emoji"),
        )

    def customers() -> DataFrame:
        return source("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))

    def projects() -> DataFrame:
        key = F.col("p_partkey")
        billable = (
            F.when(key.isin(*UNAVAILABLE_KEYS), "unavailable")
            .when(key.isin(*NONBILLABLE_KEYS) | (key % 10 == 9), "nonbillable")
            .otherwise("billable")
        )
        return source("part").select(
            project_code(key).alias("id"),
            F.col("p_name").alias("name"),
            billable.alias("billable"),
            (key % 25).cast("string").alias("customer"),
            (key % 11 != 0).alias("active"),
            (key % 10).cast("int").alias("responsible"),
            (key % 13 == 5).alias("deductable"),
        )

    def time_entry() -> DataFrame:
        staff = employees().select("id", "date_of_employment", "termination_date").withColumnRenamed("id", "employee")
        lines = source("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_suppkey").cast("int").alias("employee"),
            F.col("l_suppkey").cast("int").alias("creator"),
            F.when(F.col("l_orderkey") % 97 != 0, (F.col("l_quantity") * 30).cast("int")).alias("minutes"),
            booked_code(F.col("l_partkey")).alias("project"),
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber"))).alias("created"),
        )
        employed = (F.col("date") >= F.col("date_of_employment")) & (
            F.col("termination_date").isNull() | (F.col("date") <= F.col("termination_date"))
        )
        return lines.join(staff, "employee").filter(employed).drop("date_of_employment", "termination_date")

    @cache
    def planned(status: str) -> DataFrame:
        return source("lineitem").filter(F.col("l_linestatus") == status).select(
            F.col("l_suppkey").cast("int").alias("employee"),
            booked_code(F.col("l_partkey")).alias("project"),
            F.to_date("l_shipdate").alias("date"),
            F.when(F.col("l_discount") >= 0.05, 50).otherwise(100).alias("percentage"),
        )

    def staffing() -> DataFrame:
        return (
            planned("O")
            .filter(~is_absence_reason(F.col("project")))
            .groupBy("employee", "project", "date")
            .agg(F.max("percentage").alias("percentage"))
        )

    def absence() -> DataFrame:
        return (
            planned("F")
            .filter(is_absence_reason(F.col("project")))
            .join(holidays().select("date"), "date", "left_anti")
            .select(F.col("employee").alias("employee_id"), "date", F.col("project").alias("reason"))
            .distinct()
            .withColumn("percentage", F.lit(100))
        )

    @cache
    def holidays() -> DataFrame:
        return holidays_dimension(spark, *HOLIDAYS)

    @cache
    def invoices() -> DataFrame:
        orders = source("orders").select("*", booked_code(F.col("o_orderkey") % 200).alias("project"))
        return orders.withColumn("date", F.last_day("o_orderdate")).withColumn(
            "invoice_balance", F.concat_ws("|", "project", F.col("date").cast("string"))
        )

    def invoice_balance() -> DataFrame:
        # Smallest status name; compared by rank because numbers aggregate in a hash table and text does not.
        rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
        names = F.array(F.lit("not_done"), F.lit("ok"), F.lit("sent"))
        return (
            invoices()
            .groupBy(F.col("invoice_balance").alias("id"), "project", "date")
            .agg(
                F.sum(F.col("o_totalprice").cast("decimal(10,2)")).alias("amount"),
                F.sum(F.col("o_custkey") % 40 * 60).cast("int").alias("minutes"),
                F.element_at(names, F.min(rank)).alias("status"),
            )
            .withColumn("created", F.col("date"))
            .withColumn("invoicenumber", F.lit(None).cast("string"))
        )

    def expense() -> DataFrame:
        return invoices().select(
            F.col("o_orderkey").cast("string").alias("id"),
            "invoice_balance",
            F.when(F.col("o_orderkey") % 2 == 0, "subcontractor").otherwise("other").alias("type"),
            (F.col("o_custkey") * 7 + 100).cast("decimal(10,2)").alias("amount"),
            F.col("date").alias("created"),
            F.lit(None).cast("string").alias("comment"),
        )

    def write_off() -> DataFrame:
        return invoices().select(
            F.col("o_orderkey").cast("string").alias("id"),
            "invoice_balance",
            (F.col("o_custkey") % 10 * 30).cast("int").alias("minutes"),
            F.col("date").alias("created"),
        )

    def paid_overtime() -> DataFrame:
        key = F.col("o_orderkey")
        day = F.to_date("o_orderdate")
        return source("orders").select(
            key.cast("int").alias("id"),
            (F.col("o_custkey") % 10).cast("int").alias("employee"),
            F.when(key % 100 != 0, day).alias("paid_date"),
            (F.col("o_custkey") % 8 + 1).cast("int").alias("minutes"),
            F.col("o_orderpriority").alias("comment"),
            day.alias("registered_date"),
        )

    def vacation_days() -> DataFrame:
        key = F.col("s_suppkey")
        years = F.sequence(F.lit(1996), (F.lit(1996) + key % 4).cast("int"))
        return source("supplier").select(
            key.cast("int").alias("employee_id"),
            F.explode(years).alias("year"),
            (key % 6 + 25).cast("double").alias("days_earnt"),
        )

    def timelock_events() -> DataFrame:
        return source("events").select(
            F.col("event_id").cast("string").alias("id"),
            F.col("ts").alias("created"),
            F.lit(0).alias("creator"),
            (F.col("user_id") % 10).cast("int").alias("employee"),
            F.date_sub(F.to_date("ts"), 7).alias("commit_date"),
        )

    def employee_role() -> DataFrame:
        return source("supplier").filter("s_acctbal >= 5000").select(
            F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("id"),
            F.col("s_suppkey").cast("int").alias("employee_id"),
            F.lit("admin").alias("role_type"),
        )

    def employee_tenure_role() -> DataFrame:
        key = F.col("s_suppkey")
        return source("supplier").filter("s_acctbal < 3000").select(
            F.concat(F.lit("t"), key.cast("string")).alias("id"),
            F.lit(dt.date(1997, 1, 1)).alias("from_date"),
            F.when(key % 2 == 1, F.lit(dt.date(1998, 6, 30))).alias("to_date"),
            key.cast("int").alias("employee_id"),
            F.lit("Leader").alias("tenure_role"),
        )

    def reporting_visibility() -> DataFrame:
        day = F.col("o_orderdate")
        return (
            source("orders")
            .groupBy(F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("year"), F.weekofyear(day).alias("week"))
            .agg(
                (F.count("*") * 37.5).alias("available_hours"),
                F.sum(F.col("o_custkey") % 38).cast("double").alias("billable_hours"),
            )
            .withColumn("unavailable_hours", F.lit(0.0))
        )

    makers = (
        employees, customers, projects, time_entry, staffing, absence, holidays, invoice_balance, expense, write_off,
        paid_overtime, vacation_days, timelock_events, employee_role, employee_tenure_role, reporting_visibility,
    )
    plain = {name: (lambda name=name: source(name)) for name in ("orders", "documents")}
    return Tables(spark, {make.__name__: make for make in makers} | plain)


def contract_tables(t: Tables) -> Tables:
    """The same with tables that only the contract report looks at, from orders, customers and employees. Many of their
    rows break a rule."""
    key, customer, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    at = F.col("o_orderdate")
    some = t.orders.filter("o_orderkey % 5 = 0")
    project = booked_code(key % 200)
    ten = (customer % 10).cast("int")

    def text(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    number = F.col("id").cast("int")
    return t.replace(
        talks=some.select(
            (key % 3000).cast("int").alias("id"), (customer % 120).cast("int").alias("employee"), day.alias("talk_date"),
            F.lit("t").alias("title"), F.lit("l").alias("location"), at.alias("created"),
        ),
        project_sdg_events=some.select(
            key.cast("int").alias("event_id"), F.lit("e").alias("event_type"), at.alias("created_at"),
            ten.alias("caused_by"), project.alias("project"), F.when(key % 20 != 0, ten).alias("goal"),
        ),
        time_entry_comments=some.select(
            key.cast("string").alias("id"), (key % 3).cast("int").alias("employee"), (customer % 130).cast("int").alias("creator"),
            F.lit("c").alias("comment"), booked_code(key % 100).alias("project"), F.trunc(day, "year").alias("date"), at.alias("created"),
        ),
        invoice_lock_events=some.select(
            key.cast("string").alias("id"), project.alias("project_id"), ten.alias("creator_id"), at.alias("created_at"),
            key.cast("int").alias("order_id"), F.when(key % 89 != 0, day).alias("commit_date"),
        ),
        ranked_games=t.customers.select(text("g", F.col("id")).alias("id"), F.col("name").alias("title")),
        ranked_matchups=some.select(
            key.cast("string").alias("id"), text("g", customer % 27).alias("game_id"), ten.alias("user1_id"),
            (key / 5 % 10).cast("int").alias("user2_id"),
            F.when(F.col("o_orderstatus") == "F", "WIN").when(F.col("o_orderstatus") == "O", "LOSS").otherwise("DRAW").alias("matchup_result"),
            at.alias("created_at"),
        ),
        employee_settings=t.employees.withColumn("again", F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 4 == 0, 1).otherwise(0)))).select(
            F.col("id").alias("employee_id"),
            *[F.lit(True).alias(c) for c in ("slack", "delegate", "deadline", "week_before_deadline", "termination")],
            F.when(F.col("id") % 7 != 0, True).alias("hired"),
        ),
        employee_task=some.select(
            key.cast("string").alias("id"), text("t", customer % 30).alias("task_id"), F.lit(False).alias("completed"),
            ten.alias("employee_id"), ten.alias("responsible_id"), at.alias("due_date"), at.alias("completed_date"),
            F.when(key % 2 == 0, customer % 140).cast("int").alias("completed_by_id"),
        ),
        employee_task_comments=some.select(
            key.cast("string").alias("id"), F.lit("x").alias("text"), at.alias("created_at"), ten.alias("created_by_id"),
            (key + 25).cast("string").alias("employee_task_id"),
        ),
        notification=some.select(
            key.cast("string").alias("id"), (customer % 110).cast("int").alias("employee_id"),
            F.when(key % 3 == 0, ten).alias("created_by"), at.alias("created_at"), F.lit(False).alias("read"), F.lit("d").alias("description"),
        ),
        phase=t.customers.select(
            text("p", F.col("id")).alias("id"), F.col("name").alias("title"), text("s", number % 6).alias("process_template_id"),
            F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("created_at"), F.lit(True).alias("active"),
        ),
        process_template=t.customers.filter("cast(id as int) < 5").select(F.col("name").alias("title"), text("s", F.col("id")).alias("slug")),
        profession=t.customers.select(text("q", number % 20).alias("slug"), text("n", number % 12).alias("title")),
        profession_task=t.customers.select(text("q", number % 22).alias("profession_id"), text("t", number % 23).alias("task_id")),
        task=t.customers.select(
            text("t", F.col("id")).alias("id"), F.col("name").alias("title"), F.lit(True).alias("global"),
            text("p", number + 1).alias("phase_id"), (number * 9).alias("responsible_id"),
            F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("created_at"), F.lit(True).alias("active"),
            F.when(number % 3 == 0, "OTHER").when(number % 3 == 1, "HR_MANAGER").otherwise("NOBODY").alias("responsible_type"),
        ),
    )
