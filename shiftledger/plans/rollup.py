"""A stored daily roll-up of time entries, by employee, date and project class.

The period reports read it in place of the entries when a set of tables has it as ``entry_rollup``. It is stored by month
and made again for the months that changed. A class that a project changes to, or a project that appears later, counts
from the next time that its months are made.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.functions.codes import BONUS_PROJECTS, PROFESSIONAL_DEVELOPMENT, SELF_REPORTED_SICK
from shiftledger.plans.periods import MONTH
from shiftledger.sources.tables import Tables

ROLLUP = """
    employee INT, date DATE, billable STRING, minutes BIGINT, entries BIGINT, deductable_minutes BIGINT,
    sick_minutes BIGINT, development_minutes BIGINT, bonus_minutes BIGINT, timed BIGINT, last_created TIMESTAMP_NTZ,
    month INT"""


def month_of(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def entry_rollup(t: Tables, months: Iterable[int] | None = None) -> DataFrame:
    """The roll-up of all entries, or of those in some months (YYYYMM).

    ``minutes`` stay NULL where no entry has any; ``timed`` counts entries with a time of creation. Entries on unknown
    projects have no class. Rows combine inside each task before they are shuffled.
    """
    entries = t.time_entry.select("employee", "project", "date", "minutes", "created")
    if months is not None:
        known = sorted(set(months))
        entries = entries.filter(month_of(F.col("date")).isin(known)) if known else entries.limit(0)
        if known:  # bounds that reach the scan
            low, high = (F.make_date(F.lit(m // 100), F.lit(m % 100), F.lit(1)) for m in (known[0], known[-1]))
            entries = entries.filter(F.col("date").between(low, F.last_day(high)))
    classes = t.projects.select(F.col("id").alias("project"), "billable", "deductable")

    def minutes_of(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("minutes")))

    project = F.col("project")
    return (
        entries.join(classes, "project", "left")
        .groupBy("employee", "date", "billable")
        .agg(
            F.sum("minutes").alias("minutes"),
            F.count("*").alias("entries"),
            minutes_of(F.col("deductable")).alias("deductable_minutes"),
            minutes_of(project == SELF_REPORTED_SICK).alias("sick_minutes"),
            minutes_of(project == PROFESSIONAL_DEVELOPMENT).alias("development_minutes"),
            minutes_of(project.isin(*BONUS_PROJECTS) & F.col("billable").isNotNull()).alias("bonus_minutes"),
            F.count("created").alias("timed"),
            F.max("created").alias("last_created"),
        )
        .withColumn(MONTH, month_of(F.col("date")))
    )


def read_rollup(t: Tables, path: str) -> Tables:
    """The same tables, whose reports read the roll-up stored at ``path``."""
    return t.replace(entry_rollup=t.spark.read.schema(ROLLUP).parquet(path))
