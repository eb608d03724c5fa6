"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). A block of vectors is indexed by dimension: its rows in order of value, so
that the rows with one value are a posting segment. For a query, the impact of a segment is |q * value|. Segments are
added to the scores in descending impact, from both ends of each dimension, level by level. After a level with lower
limit t, what a row has not yet met adds less than t for each dimension it was not seen in, so its score lies within
known bounds. When the rows whose upper bound reaches the k-th best lower bound are few, they alone can be among the
best k: the search stops on that proof and scores them exactly.

Queries are a stated part of the rows. Blocks of queries meet blocks of vectors; a block of vectors is one task's
work with all query blocks streaming by, and gives its best k of each query. The best of those are taken by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, saved

SCALE = 64
K = 20
BLOCK = 8192
QUERIES = 256
#: Components are longs; scores that could pass this are added up as integers of any size instead of by the index.
LARGEST = 1 << 62
EXACT = 1 << 52
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def quantised(batch_values: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors, shorter ones filled with zeros, and which rows are valid. Fails where one does not fit."""
    lengths = np.diff(batch_values.offsets.to_numpy())
    flat = batch_values.values.slice(batch_values.offsets[0].as_py(), int(lengths.sum()))
    given = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    fine = np.isfinite(given)
    with np.errstate(invalid="ignore", over="ignore"):
        numbers = np.floor(given * scale)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    valid = np.bincount(row, ~fine, len(lengths)) == 0
    valid &= ~np.asarray(batch_values.is_null())
    if (np.abs(numbers[fine & valid[row]]) >= LARGEST).any():
        raise OverflowError("a component does not fit a long after scaling")
    fine &= valid[row]
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[row[fine], column[fine]] = numbers[fine].astype(np.int64)
    return out, valid


def blocks(embeddings: DataFrame, scale: float, size: int) -> DataFrame:
    """(block, width, ids, vectors): up to `size` vectors of a partition in a row."""
    kinds = "block long, width int, ids binary, vectors binary"
    schema = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def close(parts: list) -> pa.RecordBatch:
            width = max(v.shape[1] for _, v in parts)
            wide = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in parts]
            ids, vectors = np.concatenate([i for i, _ in parts]), np.concatenate(wide)
            kind = "<i4" if np.abs(vectors).max(initial=0) < 1 << 31 else "<i8"
            return batch_of(schema, [number], [width], [ids.astype("<i8").tobytes()], [vectors.astype(kind).tobytes()])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors, valid = quantised(pa.array(part.column(1)), scale)
                known = valid & ~np.asarray(part.column(0).is_null())
                ids = part.column(0).fill_null(0).to_numpy()[known]
                if sum(len(i) for i, _ in held) + len(ids) > size and held:
                    yield close(held)
                    number, held = number + 1, []
                if len(ids):
                    held.append((ids, vectors[known]))
        if held:
            yield close(held)

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, kinds)


def unpacked(raw: bytes, rows: int, width: int) -> np.ndarray:
    """Vectors as blocks() packs them, in as many bytes as the largest needs."""
    kind = "<i8" if len(raw) == 8 * rows * width else "<i4"
    return np.frombuffer(raw, kind).reshape(rows, width).astype(np.int64)


class Index:
    """Per dimension the rows in order of value; rows of one value are a posting segment."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.n, self.width = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors, self.order.T, axis=0).T.copy()
        self.largest = np.abs(self.values[:, [0, -1]]).max(axis=1)
        self.usual = np.abs(vectors).mean(axis=0)

    def best(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that can be among its best k + 1, ties included, and their exact scores."""
        queries = queries[:, : self.width]
        if (np.abs(queries).max(axis=0).astype(float) * self.largest[: queries.shape[1]]).sum() >= EXACT:
            yield from self._exactly(queries, k)
            return
        size = np.abs(queries)
        most = size.max(axis=0)  # the impact of a segment is its value's size times the largest component asked for
        reach = int((most * self.largest).sum())
        kind = np.int32 if reach < 1 << 30 else np.int64
        asked = np.flatnonzero(most * self.largest)
        score = np.zeros((self.n, len(queries)), kind)
        exact = np.float32 if reach < 1 << 23 else np.float64  # whole numbers of this size are exact in it
        low, high = np.zeros(self.width, np.int64), np.full(self.width, self.n)
        level = max(float((most * self.usual)[asked].mean()) / 2, 1.0) if len(asked) else 1.0
        few, rows = max(4 * k, self.n // 16), None
        narrow = queries.astype(kind)
        while self.n > few:
            limit = np.ones(self.width, np.int64)  # segments of at least this value are added; zeros add nothing
            limit[asked] = np.maximum(np.ceil(level / most[asked]), 1)
            for d in asked[np.argsort(-(most * self.largest)[asked], kind="stable")]:
                values, order, part = self.values[d], self.order[d], narrow[:, d]
                a, b = low[d], min(np.searchsorted(values, -limit[d], "right"), high[d])
                c, e = max(np.searchsorted(values, limit[d], "left"), b), high[d]
                low[d], high[d] = b, c
                for first, last in ((a, b), (c, e)):
                    for at in range(first, last, 1024):
                        some = slice(at, min(at + 1024, last))
                        score[order[some]] += values[some].astype(kind)[:, None] * part[None, :]
            if (limit[asked] == 1).all():
                break  # everything is added
            unseen = (np.abs(self.vectors[:, asked]) < limit[asked]).astype(exact)
            rest = (unseen @ (size * (limit - 1))[:, asked].T.astype(exact)).astype(kind)
            bound = np.partition(score - rest, self.n - k - 1, axis=0)[self.n - k - 1]
            possible = score + rest >= bound[None, :]
            if possible.sum(axis=0).mean() <= few:
                rows = possible
                break
            level /= 3
        for i, query in enumerate(queries):
            found = np.arange(self.n) if rows is None else np.flatnonzero(rows[:, i])
            yield found, self.vectors[found, : len(query)] @ query


    def _exactly(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same by integers of any size; scores that do not fit a long become the least or the greatest one."""
        rows = self.vectors[:, : queries.shape[1]].astype(object)
        for query in queries.astype(object):
            score = rows @ query
            least = sorted(score.tolist(), reverse=True)[: k + 1][-1]
            found = np.flatnonzero((score >= least).astype(bool))
            yield found, np.array([min(max(x, LEAST), GREATEST) for x in score[found].tolist()], np.int64)


def top_k(
    embeddings: DataFrame, k: int = K, every: int = 20, scale: float = SCALE, block: int = BLOCK, queries: int = QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` the k highest inner products
    with other rows, ties to the smaller vec_id; fewer if there are fewer.

    Rows with a null vec_id, a null vector, or a null or non-finite component take no part. A component of 2^62 or more
    after scaling, and a score among the best that does not fit a long, fail. Missing components of shorter vectors count as zero. Repeated rows are rows of their own: a query meets its
    repetition, and a repeated query is answered each time. Empty tables give an empty result; other columns are
    ignored.
    """
    held = saved(blocks(embeddings, scale, block), "blocks")
    asked_kinds = "part long, width int, rows binary, ids binary, vectors binary"
    asked_schema = pa.schema(
        [("part", pa.int64()), ("width", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())]
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, width, raw_ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw_ids, "<i8")
                vectors = unpacked(raw, len(ids), width)
                rows = np.flatnonzero(ids % every == 0)
                for at in range(0, len(rows), queries):
                    some = rows[at : at + queries]
                    columns = (some.astype("<i8").tobytes(), ids[some].tobytes(), vectors[some].tobytes())
                    yield batch_of(asked_schema, [number], [width], *([c] for c in columns))

    number = held.count()
    lanes = F.sequence(F.lit(0), F.lit(max(number, 1) - 1))
    asked = held.mapInArrow(ask, asked_kinds).select("*", F.explode(lanes).alias("lane"))
    numbered = held.select("block").withColumn("lane", F.row_number().over(Window.orderBy("block")) - 1)
    sought = held.join(numbered, "block").select(
        "lane", "block", F.col("width").alias("w"), F.col("ids").alias("i"), F.col("vectors").alias("v")
    )
    met = asked.repartition(max(number, 1), "lane").join(sought.repartition(max(number, 1), "lane"), "lane")
    kinds = "part long, row long, query_id long, vec_id long, score long"
    schema = pa.schema([(n, pa.int64()) for n in ("part", "row", "query_id", "vec_id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, ids = None, None, None
        for batch in batches:
            for line in range(batch.num_rows):
                one = {n: batch.column(n)[line].as_py() for n in ("part", "width", "rows", "ids", "vectors", "block", "w")}
                if one["block"] != last:
                    last, ids = one["block"], np.frombuffer(batch.column("i")[line].as_py(), "<i8")
                    index = Index(unpacked(batch.column("v")[line].as_py(), len(ids), one["w"]))
                rows, query_ids = np.frombuffer(one["rows"], "<i8"), np.frombuffer(one["ids"], "<i8")
                vectors = unpacked(one["vectors"], len(rows), one["width"])
                parts = []
                for row, query_id, (found, score) in zip(rows, query_ids, index.best(vectors, k), strict=True):
                    if one["part"] == last:
                        found, score = found[found != row], score[found != row]
                    top = np.lexsort((ids[found], -score))[:k]
                    size = len(top)
                    parts.append((np.full(size, one["part"]), np.full(size, row), np.full(size, query_id), ids[found[top]], score[top]))
                yield batch_of(schema, *map(np.concatenate, zip(*parts, strict=True)))

    found = met.select("part", "width", "rows", "ids", "vectors", "block", "w", "i", "v").mapInArrow(search, kinds)
    best = Window.partitionBy("part", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    unfit = F.raise_error(F.lit("a score does not fit a long")).cast("long")
    score = F.when(F.col("score").isin(LEAST, GREATEST), unfit).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
