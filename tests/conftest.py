from __future__ import annotations

import datetime as dt
import re
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shiftledger import Tables  # noqa: E402
from shiftledger.schemas import SCHEMAS  # noqa: E402

EMPTY = {
    "INT": 0,
    "STRING": "",
    "DATE": dt.date(2000, 1, 1),
    "BOOLEAN": False,
    "DOUBLE": 0.0,
    "DECIMAL(10,2)": Decimal(0),
    "TIMESTAMP_NTZ": dt.datetime(2000, 1, 1),
}
DEFAULTS = {
    "projects": {"active": True, "customer": "c", "billable": "billable"},
    "employees": {"has_permanent_position": True, "gender": "other"},
    "staffing": {"percentage": 100},
    "absence": {"percentage": 100},
    "invoice_balance": {"status": "not_done"},
    "expense": {"type": "other"},
}


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def columns_of(table: str) -> list[tuple[str, str, bool]]:
    parts = re.findall(r"(\w+) (DECIMAL\(10,2\)|\w+)( NOT NULL)?", SCHEMAS[table])
    return [(name, kind, bool(required)) for name, kind, required in parts]


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from short rows: columns not given are NULL where allowed, and a neutral value otherwise."""

    def make(**tables: list[dict]) -> Tables:
        frames = {}
        for name in SCHEMAS:
            rows = []
            for i, row in enumerate(tables.get(name, [])):
                defaults = DEFAULTS.get(name, {})
                full = {c: EMPTY[kind] if required else None for c, kind, required in columns_of(name)}
                if "id" in full and "id" not in row:
                    full["id"] = i if dict((c, k) for c, k, _ in columns_of(name))["id"] == "INT" else f"{name}-{i}"
                rows.append(tuple({**full, **defaults, **row}.values()))
            frames[name] = spark.createDataFrame(rows, SCHEMAS[name])
        return Tables(spark, frames)

    return make


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows_of(frame, *columns: str) -> list[tuple]:
    chosen = frame.select(*columns) if columns else frame
    return in_order(tuple(r) for r in chosen.collect())


def in_order(rows) -> list[tuple]:
    """Sorted, NULL first."""
    return sorted(rows, key=lambda row: tuple((x is not None, x) for x in row))
