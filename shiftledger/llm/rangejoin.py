"""Near-duplicate embeddings by an exact metric range join.

Of unit vectors, a cosine of at least t is a distance of at most r = sqrt(2 - 2t). Vectors of a label are split by
pivots: each lies in the cell of its nearest one. If x lies in the cell of p and y, within r of x, in that of q, then
the triangle inequality gives d(x, q) - d(x, p) <= 2r, so x is also sent to every cell with a smaller number for which
that holds (and for which the plane between p and q is within r of x, which is sharper), and each pair meets in exactly
one cell. Cells are joined independently. Two vectors within r / 2 of the pivot of their cell are linked by the
triangle inequality alone: they are counted, never compared, so a heap of near copies around a pivot costs one row each.

Equal vectors are folded first and carry their number. Pivots that lie close to each other are thinned out, so that a
hot heap is not cut into cells that all reach each other. A cell with many rows is dealt into blocks, and each pair of
blocks is a group of its own with a bounded number of rows. What leaves a group is, for each vector, its number of
links there and one edge of a spanning forest: no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, records, saved
from shiftledger.llm.graph import components

COSINE = 0.98
#: Sizes of work; results are the same with others. Vectors of a label for one pivot, pivots of a label at most,
#: vectors of a block, vectors that one task compares with the pivots at once.
CELL = 2048
PIVOTS = 512
BLOCK = 2048
DEAL = 16_384
#: Cosines this close to a bound are not trusted to one rounding, nor are distances, which are roots of differences.
NEAR, FAR = 1e-9, 1e-6
_CORE, _OUTER, _GUEST = 0, 1, 2
_LABELS = "label string, width int"


def _doubles(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled by a power of two before, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1))
    rows = np.ldexp(rows, -exponent[:, None])
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine in double precision with sums that are rounded once, so the order of the two makes no difference."""
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def _linked(left: np.ndarray, right: np.ndarray, ul: np.ndarray, ur: np.ndarray, least: float) -> np.ndarray:
    """Which rows of left (unit vectors: ul) are linked with which of right."""
    cosines = ul @ ur.T
    hit = cosines >= least
    for i, j in np.argwhere(np.abs(cosines - least) < NEAR).tolist():
        hit[i, j] = cosine(left[i], right[j]) >= least
    return hit


def _folded(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, key), and the distinct vectors that may link as (rid, key, label, width, raw, n, first)."""
    number = lambda x: x.cast("double")
    fine = lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf")))
    vector = F.col("embedding")
    takes_part = F.col("label").isNotNull() & vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)
    ids = F.col("vec_id").cast("long").alias("vec_id")
    label = F.col("label").cast("string").alias("label")
    rows = embeddings.select(ids, label, F.when(takes_part, F.transform(vector, number)).alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in records(batches, 1024):
            raw = [None if v is None else (np.array(v, np.float64) + 0.0).tobytes() for v in vectors]
            yield batch_of(schema, ids, labels, [None if r is None else len(r) // 8 for r in raw], raw)

    # a negative zero becomes a zero there, so that equal vectors have equal bytes
    packed = rows.mapInArrow(run, "vec_id long, label string, width int, raw binary")
    # null for what links with nothing; 256 bits of label and vector else
    key = F.when(F.col("raw").isNotNull(), F.unhex(F.sha2(F.concat(F.col("raw"), F.encode("label", "UTF-8")), 256)))
    packed = saved(packed.withColumn("key", key), "vectors")
    distinct = (
        packed.where("key is not null")
        .groupBy("key")
        .agg(
            F.first("label").alias("label"),
            F.first("width").alias("width"),
            F.first("raw").alias("raw"),
            F.count("*").alias("n"),
            F.min("vec_id").alias("first"),
        )
    )
    distinct = saved(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    return packed.select("vec_id", "key"), distinct


def _pivots(distinct: DataFrame, apart: float, cell: int, pivots: int) -> DataFrame:
    """(label, width, rows, raws): per label its number of vectors and its pivots, an array of raw vectors.

    The number of pivots follows from the size of the label, up to `pivots`. Vectors are dealt to as many lots by a
    hash, and the least hash of each lot is drawn; then, in order, those closer than `apart` to an earlier one go.
    """
    sizes = distinct.groupBy("label", "width").agg(F.count("*").alias("rows"))
    sizes = saved(sizes.withColumn("lots", F.least(F.ceil(F.col("rows") / cell), F.lit(pivots)).cast("int")), "sizes")
    dealt = distinct.select("label", "width", "raw", F.xxhash64("key").alias("h")).join(sizes, ["label", "width"])
    drawn = dealt.groupBy("label", "width", F.pmod("h", "lots").alias("lot")).agg(F.min_by("raw", "h").alias("raw"))
    schema = pa.schema([("label", pa.string()), ("width", pa.int32()), ("raws", pa.list_(pa.binary()))])

    def thinned(table: pa.Table) -> pa.Table:
        table = table.sort_by("lot")
        raw = table.column("raw").to_pylist()
        units = _units(_doubles(raw))
        kept: list[int] = []
        for i in range(len(raw)):
            if not kept or ((units[kept] - units[i]) ** 2).sum(axis=1).min() >= apart * apart:
                kept.append(i)
        first = table.slice(0, 1)
        return pa.table([first.column("label"), first.column("width"), [[raw[i] for i in kept]]], schema=schema)

    chosen = drawn.groupBy("label", "width").applyInArrow(thinned, f"{_LABELS}, raws array<binary>")
    return saved(chosen.join(sizes.drop("lots"), ["label", "width"]), "pivots")


def _dealt(distinct: DataFrame, pivots: DataFrame, radius: float, deal: int) -> DataFrame:
    """(label, width, cell, kind, rid, n, raw): every vector in its own cell, and as a guest in those it must reach.

    Vectors of a label come in groups of about `deal` rows, each with the label's pivots, of which there are a bounded
    number.
    """
    parts = F.ceil(F.col("rows") / deal).cast("int")
    counted = pivots.select("label", "width", parts.alias("parts"))
    rows = distinct.select("label", "width", "rid", "n", "raw").join(counted, ["label", "width"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")
    asked = pivots.select("label", "width", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "raws")
    kinds = f"{_LABELS}, cell int, kind int, rid long, n long, raw binary"
    schema = pa.schema(
        [("label", pa.string()), ("width", pa.int32()), ("cell", pa.int32()), ("kind", pa.int32())]
        + [("rid", pa.int64()), ("n", pa.int64()), ("raw", pa.binary())]
    )

    def placed(group: pa.Table, centres: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        points = _units(_doubles(centres.column("raws")[0].as_py()))
        apart = np.sqrt(np.maximum(2 - 2 * (points @ points.T), 0))
        out = []
        for start in range(0, group.num_rows, 4096):
            part = group.slice(start, 4096)
            units = _units(_doubles(part.column("raw").to_pylist()))
            far = np.sqrt(np.maximum(2 - 2 * (units @ points.T), 0))
            home = far.argmin(axis=1)
            nearest = far[np.arange(len(units)), home]
            reach = far - nearest[:, None] <= 2 * radius + FAR
            plane = far * far - (nearest * nearest)[:, None] <= 2 * (radius + NEAR) * apart[home] + NEAR
            guest = reach & plane & (np.arange(len(points))[None, :] < home[:, None])
            core = nearest <= radius / 2 - FAR
            who, cell = np.nonzero(guest)
            at = np.concatenate((np.arange(len(units)), who))
            cells = np.concatenate((home, cell)).astype(np.int32)
            kind = np.concatenate((np.where(core, _CORE, _OUTER), np.full(len(who), _GUEST))).astype(np.int32)
            taken = part.select(["label", "width", "rid", "n", "raw"]).take(pa.array(at))
            out.append(taken.append_column("cell", pa.array(cells)).append_column("kind", pa.array(kind)))
        return pa.concat_tables(out).select(schema.names).cast(schema)

    key = ("label", "width", "part")
    return saved(rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(placed, kinds), "cells")


def _grouped(cells: DataFrame, block: int) -> DataFrame:
    """Rows of cells, each sent to every pair of blocks that it is part of: (cell columns, a, i, b, j, side).

    A group compares block i of kind a (side 0) with block j of kind b (side 1); core with core and guest with guest
    need no comparison, and of outer ones with each other each pair of blocks comes once.
    """
    key = ["label", "width", "cell"]
    blocks = lambda kind: F.ceil(F.sum((F.col("kind") == kind).cast("int")) / block).cast("int")
    sizes = cells.groupBy(*key).agg(*(blocks(k).alias(f"b{k}") for k in (_CORE, _OUTER, _GUEST)))
    met = cells.join(saved(sizes, "sizes"), key)
    count = F.element_at(F.array("b0", "b1", "b2"), F.col("kind") + 1)
    met = met.withColumn("own", F.pmod(F.xxhash64("rid"), count).cast("int"))

    def groups(own_kind: int, other: int) -> Column:
        others = F.when(F.col(f"b{other}") > 0, F.sequence(F.lit(0), F.col(f"b{other}") - 1)).otherwise(F.array().cast("array<int>"))

        def group(j: Column) -> Column:
            mine = F.lit(own_kind) < other if own_kind != other else F.col("own") <= j
            i, j = F.when(mine, F.col("own")).otherwise(j), F.when(mine, j).otherwise(F.col("own"))
            a, b = min(own_kind, other), max(own_kind, other)
            fields = (F.lit(a).alias("a"), i.alias("i"), F.lit(b).alias("b"), j.alias("j"), F.when(mine, 0).otherwise(1).alias("side"))
            return F.struct(*fields)

        return F.transform(others, group)

    of_kind = (
        F.when(F.col("kind") == _CORE, F.concat(groups(_CORE, _OUTER), groups(_CORE, _GUEST)))
        .when(F.col("kind") == _OUTER, F.concat(groups(_OUTER, _CORE), groups(_OUTER, _OUTER), groups(_OUTER, _GUEST)))
        .otherwise(F.concat(groups(_GUEST, _CORE), groups(_GUEST, _OUTER)))
    )
    return met.select(*key, "rid", "n", "raw", F.inline(of_kind))


def _joined(grouped: DataFrame, least: float) -> DataFrame:
    """(rid, links, root): per group and vector with links there, how many, and the least rid it is tied to there."""
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        both = []
        for s in (0, 1):
            part = table.filter(pa.array(side == s))
            raw = part.column("raw").to_pylist()
            rows = _doubles(raw) if raw else np.empty((0, 1))
            both.append((part.column("rid").to_numpy(), part.column("n").to_numpy(), rows, _units(rows) if raw else rows))
        (rid, n, rows, units), (rid2, n2, rows2, units2) = both
        alone = table.column("a")[0].as_py() == table.column("b")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if alone:
            rid2, n2, rows2, units2 = rid, n, rows, units
        if not len(rid) or not len(rid2):
            return schema.empty_table()
        links, links2 = np.zeros(len(rid), np.int64), np.zeros(len(rid2), np.int64)
        ids = rid if alone else np.concatenate((rid, rid2))
        root = ids.copy()
        shift = 0 if alone else len(rid)
        for start in range(0, len(rid), 512):
            hit = _linked(rows[start : start + 512], rows2, units[start : start + 512], units2, least)
            if alone:
                hit[np.arange(len(hit)), start + np.arange(len(hit))] = False
            links[start : start + 512] = hit @ n2
            if not alone:
                links2 += n[start : start + 512] @ hit
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                tied = np.unique(np.append(root[shift + np.flatnonzero(hit[i])], root[start + i]))
                if len(tied) > 1:
                    root[np.isin(root, tied)] = tied[0]
        counted = links if alone else np.concatenate((links, links2))
        some = counted > 0
        return pa.table([ids[some], counted[some], root[some]], schema=schema)

    key = ("label", "width", "cell", "a", "i", "b", "j")
    return grouped.groupBy(*key).applyInArrow(run, "rid long, links long, root long")


def range_classes(
    embeddings: DataFrame, least: float = COSINE, cell: int = CELL, pivots: int = PIVOTS, block: int = BLOCK, deal: int = DEAL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    `least`. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; nor do
    vectors of different lengths. component_id is the smallest vec_id reachable by links; kept says that it is the
    row's own. Repeated rows are rows of their own and link with each other. Rows with a null vec_id take part, come
    back with it, and get the id of their class (null if no row of it has one; such a row without links is kept). An
    empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("the cosine must be over zero and at most one")
    radius = math.sqrt(2 - 2 * least)
    rows, distinct = _folded(embeddings)
    chosen = _pivots(distinct, 2 * radius, cell, pivots)
    cells = _dealt(distinct, chosen, radius, deal)
    found = saved(_joined(_grouped(cells, block), least), "found")

    # vectors of a core: all of them are linked with each other
    key = ["label", "width", "cell"]
    core = cells.where(F.col("kind") == _CORE).select(*key, "rid", "n")
    whole = core.groupBy(*key).agg(F.sum("n").alias("all"), F.min("rid").alias("root"))
    near = core.join(saved(whole, "cores"), key).select("rid", (F.col("all") - F.col("n")).alias("links"), "root")
    links = found.unionByName(near)
    edges = links.where("rid <> root").select(F.col("root").alias("a"), F.col("rid").alias("b"))
    roots = components(edges)
    counts = links.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = (
        distinct.select("rid", "key", "n", "first")
        .join(roots.withColumnRenamed("node", "rid"), "rid", "left")
        .join(counts, "rid", "left")
        .select("key", "first", F.coalesce("root", "rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    classes = saved(classes, "classes")
    smallest = classes.groupBy("root").agg(F.min("first").alias("least_id"))
    named = classes.join(smallest, "root").select("key", "n_links", "least_id")
    # null keys are spread over the join by the id, which no class has as its key
    spread = F.coalesce(F.col("key"), F.col("vec_id").cast("string").cast("binary"))
    out = rows.withColumn("at", spread).join(named.withColumnRenamed("key", "at"), "at", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("least_id"))
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
