"""Tables stored by month: only the months that a change touches are written again.

Such a table lies in ``<path>/month=YYYYMM/``; rows belong to the month of their date. A batch of changes is staged
first, with the rows it reports, and then put in place of the old months, so nothing is read after it was replaced. The
second step may be run again after a failure: it only copies what was staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.operators.changes import Change
from shiftledger.plans.periods import MONTH
from shiftledger.plans.rollup import entry_rollup, month_of
from shiftledger.schemas import SCHEMAS
from shiftledger.sources.tables import Tables


def _with_month(frame: DataFrame) -> DataFrame:
    return frame.withColumn(MONTH, month_of(F.col("date")))


def _of_months(frame: DataFrame, months: list[int]) -> DataFrame:
    return frame.filter(F.col(MONTH).isin(months)) if months else frame.limit(0)


def _write(frame: DataFrame, path: str, mode: str, gathered: bool = False) -> None:
    """Files of a month in as few tasks as their size asks for; a large month is split. Rows are sorted inside files,
    so that scans skip row groups. Rows ``gathered`` already, as those read from such files, are not moved."""
    order = [c for c in (MONTH, "date", "employee") if c in frame.columns]
    rows = (frame if gathered else frame.hint("rebalance", MONTH)).sortWithinPartitions(*order)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_months(frame: DataFrame, path: str) -> None:
    """Store a whole table by the month of its date; refuses to overwrite."""
    _write(_with_month(frame), path, "errorifexists")


def replace_months(frame: DataFrame, path: str, months: dict[int, int], gathered: bool = False) -> None:
    """Put the rows of ``frame``, which has the month, in place of the stored ones of the given months.

    ``months`` has the number of new rows of each; a month without any is deleted. Files of other months stay. The
    frame must not read ``path``.
    """
    filled = sorted(m for m, rows in months.items() if rows)
    if filled:
        _write(_of_months(frame, filled), path, "overwrite", gathered)
    for month in sorted(m for m, rows in months.items() if not rows):
        _delete(frame.sparkSession, f"{path}/{MONTH}={month}")


def changed_months(old: DataFrame, new: DataFrame) -> dict[int, int]:
    """Months whose rows differ between two versions that have the same columns, with the new number of rows.

    Each version is folded to a count and sums of two row hashes per month inside each task, so next to nothing is
    shuffled, and what reaches the driver grows with the calendar only. Of the long hash each half is summed, so that
    the sums of 2 billion rows of a month fit plain numbers.
    """
    columns = sorted(c for c in new.columns if c != MONTH)

    def marks(frame: DataFrame, side: str) -> DataFrame:
        rows = frame.select(MONTH, F.xxhash64(*columns).alias("_a"), F.hash(*columns).cast("long").alias("_b"))
        high, low = F.shiftright("_a", 32), F.col("_a").bitwiseAND(F.lit(0xFFFFFFFF))
        sums = F.sum(high).alias("high"), F.sum(low).alias("low"), F.sum("_b").alias("b")
        mark = F.struct(F.count("*").alias("rows"), *sums)
        return rows.groupBy(MONTH).agg(mark.alias(side))

    both = marks(old, "old").join(marks(new, "new"), MONTH, "full")
    differing = both.filter(~F.col("old").eqNullSafe(F.col("new")))
    return {r[MONTH]: r["rows"] or 0 for r in differing.select(MONTH, F.col("new.rows").alias("rows")).collect()}


@dataclass(frozen=True)
class Applied:
    """What a stored batch reports: its rows, its rejected requests, the months it wrote by table, and where it was
    staged."""

    returned: DataFrame
    rejected: DataFrame | None
    months: dict[str, dict[int, int]]
    stage: str


def _declared(frame: DataFrame, name: str) -> DataFrame:
    """The frame's columns in their declared types, in which they are stored and compared."""
    kinds = {f.name: f.dataType for f in frame.sparkSession.createDataFrame([], SCHEMAS[name]).schema.fields}
    return frame.select(*[F.col(c).cast(kinds[c]).alias(c) for c in frame.columns if c in kinds])


def stage_change(change: Change, folder: str) -> Applied:
    """Compute a batch and store, next to the tables, its reported rows and the new rows of the months it touches."""
    spark = change.returned.sparkSession
    stage = f"{folder}/_staged/{uuid.uuid4().hex}"
    change.returned.write.parquet(f"{stage}/_returned")
    rejected = None
    if change.rejected is not None:
        change.rejected.write.parquet(f"{stage}/_rejected")
        rejected = spark.read.schema(change.rejected.schema).parquet(f"{stage}/_rejected")
    months: dict[str, dict[int, int]] = {}
    for name, table in change.tables.items():
        if "date" not in table.columns:
            raise ValueError(f"{name} has no date to be stored by")
        new = _with_month(_declared(table, name))
        old = spark.read.schema(new.schema).parquet(f"{folder}/{name}")
        months[name] = changed_months(old, new)
        filled = [m for m, rows in months[name].items() if rows]
        if filled:
            _write(_of_months(new, filled), f"{stage}/{name}", "errorifexists")
    listed = [(name, m, rows) for name, of in months.items() for m, rows in of.items()]
    spark.createDataFrame(listed, "name string, month int, rows long").write.parquet(f"{stage}/_months")
    returned = spark.read.schema(change.returned.schema).parquet(f"{stage}/_returned")
    return Applied(returned, rejected, months, stage)


def apply_staged(spark: SparkSession, folder: str, stage: str) -> None:
    """Put what was staged in place of the old months. Running it again changes nothing."""
    months: dict[str, dict[int, int]] = {}
    for name, month, rows in spark.read.parquet(f"{stage}/_months").collect():
        months.setdefault(name, {})[month] = rows
    for name, of in months.items():
        staged = spark.read.parquet(f"{stage}/{name}") if any(of.values()) else spark.range(0)
        replace_months(staged, f"{folder}/{name}", of, gathered=True)


def apply_change(change: Change, folder: str) -> Applied:
    """Store a batch: the months it touches are replaced, all other files stay, and the rows that its requests report
    come back, read from where they were stored before any table changed."""
    applied = stage_change(change, folder)
    apply_staged(change.returned.sparkSession, folder, applied.stage)
    return applied



def store_rollup(t: Tables, path: str) -> None:
    """Store the daily roll-up of all entries by month."""
    _write(entry_rollup(t), path, "errorifexists")


def refresh_rollup(t: Tables, path: str, months: Iterable[int]) -> None:
    """Make the stored roll-up again for the months (YYYYMM) whose entries changed; months left without any go."""
    asked = sorted(set(months))
    rolled = entry_rollup(t, asked)
    counts = {r[MONTH]: r["count"] for r in rolled.groupBy(MONTH).count().collect()}
    replace_months(rolled, path, {m: counts.get(m, 0) for m in asked})
