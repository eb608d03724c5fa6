"""Clustering of integer vectors around centroids, each found by equal-average equal-variance search.

With S the sum of a vector's k components and V the root of k times its variance, Cauchy and Schwarz give

    k * |x - c|^2 >= (S_x - S_c)^2    and    |x - c|^2 >= (S_x - S_c)^2 / k + (V_x - V_c)^2.

Centroids are sorted by S, that is by their mean. A vector looks at them outward from its own mean. The first
inequality closes a whole side once it is out of reach; the second rejects a single centroid; what is left is computed
in integers. The first test is exact, the second has a margin for the roots' rounding, so results are exact and ties
go to the smaller number.

A round reads the stored vectors once and sends one partial sum for each task, centroid and component through the
shuffle. The driver holds the centroids (their number times the width, both parameters) and nothing that grows with the
table. No row is shuffled by its cluster, so a cluster that holds most vectors is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, drop_saved, saved

SCALE = 1024
WIDTH = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: Components below this in size are computed in 64 bits, as no square or product of the search then leaves them for
#: widths up to 64; larger ones are computed with integers of any size.
NARROW = 1 << 24
_ROWS = 4096


def _lines(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and V of every row."""
    width = batch.shape[1]
    sums = batch.sum(axis=1)
    spread = width * (batch * batch).sum(axis=1) - sums * sums
    return sums, np.sqrt(spread.astype(np.float64) / max(width, 1))


class Search:
    """The nearest of some centroids, for blocks of integer vectors."""

    def __init__(self, centres: list[list[int]]):
        kind = np.int64 if all(abs(x) < NARROW for c in centres for x in c) else object
        rows = np.array(centres, kind).reshape(len(centres), -1)
        sums, spreads = _lines(rows)
        self.numbers = np.array(sorted(range(len(centres)), key=lambda i: (sums[i], i)), np.int64)
        self.rows, self.sums, self.spreads = rows[self.numbers], sums[self.numbers], spreads[self.numbers]
        self.computed = 0

    def nearest(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for every row; ties go to the smaller number."""
        count, width = batch.shape
        kind = object if batch.dtype == object or self.rows.dtype == object else np.int64
        rows, centres, centre_sums = batch.astype(kind), self.rows.astype(kind), self.sums.astype(kind)
        sums, spreads = _lines(rows)
        right = np.searchsorted(centre_sums, sums)
        left = right - 1
        number = np.full(count, len(centres), np.int64)
        best = np.full(count, -1, np.int64).astype(kind)
        alive = np.arange(count)
        last = len(centres) - 1
        while len(alive):
            a, b = left[alive], right[alive]
            own = sums[alive]
            down = own - centre_sums[np.maximum(a, 0)]
            up = centre_sums[np.minimum(b, last)] - own
            go_down = (a >= 0) & ((b > last) | (down <= up).astype(bool))
            at = np.where(go_down, a, np.minimum(b, last))
            gap = np.where(go_down, down, up)
            found = number[alive] <= last
            # the nearer side is out of reach, so the other one is, too
            open_ = ((a >= 0) | (b <= last)) & (~found | (gap * gap <= width * best[alive]).astype(bool))
            alive, at, gap, go_down, found = alive[open_], at[open_], gap[open_], go_down[open_], found[open_]
            left[alive[go_down]] -= 1
            right[alive[~go_down]] += 1
            one, other = spreads[alive], self.spreads[at]
            apart = gap.astype(np.float64) ** 2 / max(width, 1) + (one - other) ** 2
            margin = 1e-9 * (one * one + other * other + apart + 1)
            near = ~found | (apart - margin <= best[alive].astype(np.float64))
            who, at = alive[near], at[near]
            self.computed += len(who)
            off = rows[who] - centres[at]
            distance = (off * off).sum(axis=1)
            name = self.numbers[at]
            known = number[who] <= last
            same = known & (distance == best[who]).astype(bool) & (name < number[who])
            better = ~known | (distance < best[who]).astype(bool) | same
            best[who[better]] = distance[better]
            number[who[better]] = name[better]
        return number, best


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """A column of equally long lists of decimals or longs as rows of integers."""
    lists = batch.column(column)
    values = lists.flatten()
    if pa.types.is_decimal(values.type):
        flat = np.array([int(x) for x in values.to_pylist()], object)
    else:
        flat = values.to_numpy(zero_copy_only=False)
    if flat.dtype != object and len(flat) and max(int(flat.max()), -int(flat.min())) >= NARROW:
        flat = flat.astype(object)
    return flat.reshape(batch.num_rows, -1)


def integer_vectors(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of `width` components, none of them null or non-finite, each as floor(scale * x)."""
    number = lambda x: x.cast("double")
    fine = lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf")))
    # floor() of a double is a long that saturates, so large ones go by way of a decimal, which fails where it cannot hold
    whole = lambda x: F.floor(number(x) * scale)
    big = lambda x: F.abs(number(x) * scale) >= float(1 << 62)
    exact = lambda x: F.when(big(x), number(x).cast("decimal(38,0)") * scale).otherwise(whole(x).cast("decimal(38,0)"))
    vector = F.col("embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kept = rows.where(vector.isNotNull() & (F.size(vector) == width)).where(F.forall(vector, fine))
    if kept.where(F.exists(vector, big)).isEmpty():
        return kept.select("vec_id", F.transform(vector, whole).alias("v"))
    return kept.select("vec_id", F.transform(vector, exact).cast("array<decimal(38,0)>").alias("v"))


def _first_centres(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id; of rows with one id the smaller vector comes first."""
    named = vectors.where("vec_id is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = named.select("v", order.alias("h")).orderBy("h", "v").limit(count).collect()
    return [[int(x) for x in r.v] for r in rows]


def _sums(vectors: DataFrame, centres: list[list[int]]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Exact sums of components, and numbers of vectors, by the nearest centroid."""
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0))])
    width = len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        search = Search(centres)
        totals = np.zeros((len(centres), width + 1), object)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                rows = _matrix(batch.slice(start, _ROWS), 0)
                number, _ = search.nearest(rows)
                for c in np.unique(number).tolist():
                    mine = rows[number == c]
                    totals[c, :width] += mine.sum(axis=0).astype(object)
                    totals[c, width] += len(mine)
        met = [c for c in range(len(centres)) if totals[c, width]]
        places = [p for _ in met for p in range(width + 1)]
        values = [Decimal(int(x)) for c in met for x in totals[c]]
        yield batch_of(schema, [c for c in met for _ in range(width + 1)], places, values)

    parts = vectors.select("v").mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        if r.place == width:
            counts[r.cluster] = int(r.total)
        else:
            sums.setdefault(r.cluster, [0] * width)[r.place] = int(r.total)
    return sums, counts


def _assigned(vectors: DataFrame, centres: list[list[int]]) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centres)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                number, distance = search.nearest(_matrix(part, 1))
                yield batch_of(schema, part.column(0), number, distance.tolist())

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def fitted(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after so many rounds over a stored table of integer vectors; fewer if it has fewer vectors with ids."""
    centres = _first_centres(vectors, count, seed)
    for _ in range(rounds if centres else 0):
        sums, counts = _sums(vectors, centres)
        moved = [[s // counts[i] for s in sums[i]] if i in counts else c for i, c in enumerate(centres)]
        if moved == centres:  # and so would be every later round's
            break
        centres = moved
    return centres


def clustered(
    embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that is kept.

    Vectors that are null, of another length, or hold null or non-finite components do not come back. Rows with a null
    vec_id take part but are no first centroid; repeated rows count as often as they come, each as a vector of its own,
    and may give equal centroids, of which the smaller number gets the vectors and the other stays where it is. An
    empty table, or one without any vec_id, gives an empty result. Other columns are ignored. A distance or a sum that
    does not fit its column fails.
    """
    spark = embeddings.sparkSession
    vectors = saved(integer_vectors(embeddings, width, scale), "vectors")
    centres = fitted(vectors, count, rounds, seed)
    if not centres:
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kinds)
    rows = saved(_assigned(vectors, centres), "assigned")
    drop_saved(vectors)
    # at most `count` rows from here on
    of = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = sum(int(r.total) for r in of)
    digest: Callable[[int], str] = lambda i: hashlib.sha256(",".join(map(str, centres[i])).encode()).hexdigest()
    facts = [(r.cluster, int(r.total), whole, digest(r.cluster)) for r in of]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return rows.join(F.broadcast(table), "cluster").select(*columns)
