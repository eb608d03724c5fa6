"""The set of tables an operator reads, loaded lazily."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from shiftledger.schemas import SCHEMAS


class Tables:
    """Named DataFrames. A value may be a function; it is called on first use and remembered."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = spark
        self._frames = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            frame = self._frames[name]
        except KeyError:
            raise AttributeError(f"no table named {name}") from None
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def replace(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them exchanged, e.g. after a change batch."""
        return Tables(self.spark, {**self._frames, **frames})


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """Tables stored as ``folder/<name>`` Parquet, read with their declared schema."""

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")

    return Tables(spark, {name: reader(name) for name in SCHEMAS})


def write_snapshot(frame: DataFrame, path: str, sort_by: tuple[str, ...] = ()) -> None:
    """Write a new version of a table next to the old one; the caller then switches readers to it.

    Sorting inside the files, typically by (date, employee), lets later scans skip row groups.
    Refuses to overwrite, because the frame is usually computed from the version it replaces.
    """
    if sort_by:
        frame = frame.sortWithinPartitions(*sort_by)
    frame.write.mode("errorifexists").parquet(path)
