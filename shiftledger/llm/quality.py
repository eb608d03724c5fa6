"""Quality of documents: gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.boosting import Trees, fit
from shiftledger.llm.common import batch_of, records, saved, text_bytes

#: Labelled rows that the trees are fitted on at most: those with the least hash of their doc_id.
FIT_ROWS = 20_000
_CLASSES = [
    bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t", b"\n\r", bytes(range(128, 256)),
    b".", b",", b"|", b"!", b"?", b"#$%&*^~+=_\\", b"{}[]<>();", b"/:@", b"'\"-",
]
_SHARE = np.zeros((256, len(_CLASSES)))
for _i, _class in enumerate(_CLASSES):
    _SHARE[list(_class), _i] = 1
WIDTH = len(_CLASSES) + 14


def statistics(text: bytes) -> np.ndarray:
    """Numbers that describe a text; all zero for an empty one. Whole texts are read."""
    out = np.zeros(WIDTH, np.float32)
    words = text.split()
    if not words:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(_CLASSES)] = count @ _SHARE / len(text)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    shares = count[count > 0] / len(text)
    lines = [x for x in text.split(b"\n") if x]
    distinct = len(set(words))
    n = len(words)
    out[len(_CLASSES) :] = (
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), lengths.max(), (lengths <= 3).mean(),
        (lengths >= 12).mean(), distinct / n, distinct / np.sqrt(n), sum(map(eq, words, words[1:])) / n,
        -(shares * np.log(shares)).sum(), n / len(lines) if lines else n, len(set(lines)) / len(lines) if lines else 1,
        np.log1p(len(lines)),
    )
    return out


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row; null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in records(batches, 2048):
            yield batch_of(schema, ids, [statistics(t) for t in texts])

    rows = documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, stats array<float>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may see. A row without doc_id has no label and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_of(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, quality) of at most `rows` labelled documents outside the held-out part: those with the least hash of
    doc_id, so that the sample does not depend on order or partitions. Null labels do not count; a document with
    several labels counts with each."""
    known = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    there = known.where(~held_out()).join(ids, "doc_id", "left_semi")
    return there.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)


def fit_quality(stats: DataFrame, sample: DataFrame) -> Trees:
    """Trees fitted on the statistics of a bounded sample. Without labels every score is one half."""
    found = stats.join(sample, "doc_id").orderBy("doc_id", "quality", "stats").select("stats", "quality").toArrow()
    matrix = np.array(found.column("stats").to_pylist(), np.float64).reshape(-1, WIDTH)
    return fit(matrix, np.array(found.column("quality").to_pylist(), np.float64))


def quality(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents.

    Scores use the text alone. Null and empty texts get the score of a text without words; rows without doc_id and
    repeated rows are scored like others; an empty table gives an empty result; other columns are ignored.
    """
    stats = saved(features(documents), "statistics")
    trees = fit_quality(stats, sample_of(stats, labels, rows))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            yield batch_of(schema, batch.column(0), trees.probability(flat))

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def of_quality(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of documents that are not rejected, with all their columns.

    Each row is judged by its own text where it lies, so nothing but the sample's ids and statistics is moved. Rows
    without doc_id and repeated rows are judged like others.
    """
    sample = saved(sample_of(documents, labels, rows), "sample")  # at most `rows` rows
    some = documents.select("doc_id", "text").join(F.broadcast(sample.select(F.col("doc_id").alias("__id")).distinct()), F.col("doc_id").cast("long") == F.col("__id"), "left_semi")
    trees = fit_quality(saved(features(some), "statistics"), sample)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column(place).cast(pa.string()).to_pylist()
                scores = trees.probability(np.array([statistics((t or "").encode()) for t in texts]))
                yield part.filter(pa.array(scores >= 0.5))

    return documents.mapInArrow(run, documents.schema)
