"""What the operators share: tables in the shared scratch folder, words of a text, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else the warehouse, else (one machine) a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="llm-scratch-")
        atexit.register(shutil.rmtree, _LOCAL["root"], ignore_errors=True)
    return _LOCAL["root"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, below the scratch folder. What lies there may go when the results have been written."""
    return f"{scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as a table and read again: cuts the lineage, and a lost executor costs nothing."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_saved(frame: DataFrame) -> None:
    """Delete the files of a table made by saved() that no later plan reads."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark deletes the shuffle files of finished steps before the next
    large shuffle instead of at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def records(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, ...]]:
    """Columns of small slices of the batches as Python lists, so that few long texts are held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield tuple(column.to_pylist() for column in part.columns)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_bytes(frame: DataFrame, column: str, path: str, end: str, rows_per_file: int) -> None:
    """The column's bytes one after the other into files below path, each followed by the byte `end`.

    Spark's text writer copies bytes as they are and commits whole tasks, so files are complete or absent, wherever
    the path lies.
    """
    raw = frame.select(F.col(column).cast("string").alias("value"))
    raw.write.option("lineSep", end).option("maxRecordsPerFile", rows_per_file).text(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file that write_bytes() made below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
