from __future__ import annotations

import math
import random

import numpy as np
import pytest

from shiftledger.llm import rangejoin
from tests.llm.odd import result

KINDS = "vec_id long, embedding array<double>, label int, key string, raw string, rid long, cell int, kind int, n long, root long"


def frame(spark, data):
    return spark.createDataFrame([(*d, "k", "r", 1, 2, 3, 4, 5) for d in data], KINDS).repartition(3)


def plain(data, least=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all rows with each other."""

    def norm(v):
        fine = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        return math.sqrt(sum(x * x for x in v)) if fine else None

    norms = [norm(v) for _, v, _ in data]
    root, links = list(range(len(data))), [0] * len(data)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, label) in enumerate(data):
        for j in range(i):
            w, other = data[j][1], data[j][2]
            if norms[i] is None or norms[j] is None or label is None or label != other or len(v) != len(w):
                continue
            if float(np.dot(v, w)) / (norms[i] * norms[j]) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (vec_id, _, _) in enumerate(data):
        if vec_id is not None:
            first[find(i)] = min(first.get(find(i), vec_id), vec_id)
    rows = [(d[0], links[i], first.get(find(i)), d[0] == first.get(find(i))) for i, d in enumerate(data)]
    return sorted(rows, key=repr)


def vectors(n=260, width=6, labels=3):
    rng = random.Random(5)
    seeds = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    data = []
    for i in range(n):
        base = rng.choice(seeds)
        data.append((i, [float(np.float32(x + rng.gauss(0, rng.choice((0.05, 0.2))))) for x in base], rng.randrange(labels)))
    # a heap of near copies that holds a third of all rows, and exact copies
    data += [(1000 + i, [x + rng.gauss(0, 0.02) for x in seeds[0]], 1) for i in range(150)]
    data += [(2000 + i, data[3][1], data[3][2]) for i in range(30)]
    data += [(3000, [0.0] * width, 1), (3001, None, 1), (3002, [None] * width, 1), (3003, [math.nan] * width, 1)]
    data += [(3004, [math.inf] + [0.0] * (width - 1), 1), (3005, data[7][1], None), (3006, [], 1), (3007, [-0.0] * width, 1)]
    data += [(3008, [1.0] * (width + 1), 1), (3009, [2.0] * (width + 1), 1), (3010, [1e-300] * width, 2), (3011, [3e-300] * width, 2)]
    data += [(None, data[3][1], data[3][2]), (None, [-x for x in seeds[1]], 0), (None, None, 0), data[9], data[9], (9, data[20][1], data[20][2])]
    data += [(3012, [1.0, -0.0] + [0.0] * (width - 2), 0), (3013, [1.0] + [0.0] * (width - 1), 0)]
    return data


def squares(data):
    """Tiny numbers vanish when squared, which the plain comparison cannot bear; it sees them scaled."""
    return [(i, None if v is None else [x if x is None or not 0 < abs(x) < 1e-200 else x * 1e300 for x in v], label) for i, v, label in data]


@pytest.mark.parametrize(("cell", "block", "deal"), [(rangejoin.CELL, rangejoin.BLOCK, rangejoin.DEAL), (8, 16, 50)])
def test_classes_like_brute_force(spark, cell, block, deal):
    data = vectors()
    found = rangejoin.range_classes(frame(spark, data), cell=cell, block=block, deal=deal)
    assert result(found) == plain(squares(data))


def test_many_cells_in_many_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(0, 1, (300, 64))
    near = rows[:100] + rng.normal(0, 1, (100, 64)) * rng.uniform(0.1, 0.3, (100, 1))
    data = [(i, v.tolist(), 4) for i, v in enumerate(np.concatenate((rows, near)))]
    want = plain(data)
    assert 20 < sum(r[1] > 0 for r in want) < 200
    assert result(rangejoin.range_classes(frame(spark, data), cell=10, block=32, deal=64)) == want


def test_chains_on_the_threshold(spark):
    """Steps of an angle just under and over the bound, in all directions of a chain."""
    step = math.acos(0.98)
    angles = [i * step * f for i in range(12) for f in (1 - 1e-12, 1 + 1e-12, 0.5)]
    data = [(i, [math.cos(a), math.sin(a)], 1) for i, a in enumerate(angles)]
    assert result(rangejoin.range_classes(frame(spark, data), cell=3, block=4, deal=8)) == plain(data)


def test_a_heap_of_near_copies_is_not_compared_pair_by_pair(spark):
    """Rows sent to comparisons grow with the heap, not with its square."""
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, 32)
    sent = []
    for n in (400, 1600):
        data = [(i, (base + rng.normal(0, 0.01, 32)).tolist(), 1) for i in range(n)]
        _, distinct = rangejoin._folded(frame(spark, data))
        chosen = rangejoin._pivots(distinct, 0.4, 20, rangejoin.PIVOTS)
        cells = rangejoin._dealt(distinct, chosen, 0.2, 100)
        sent.append(cells.count() + rangejoin._grouped(cells, 32).count())
        found = rangejoin.range_classes(frame(spark, data), cell=20, block=32, deal=100)
        assert {tuple(r)[1:3] for r in found.collect()} == {(n - 1, 0)}
    assert sent[1] <= 4 * sent[0]


def test_empty_tables(spark):
    data = vectors()[:3]
    assert rangejoin.range_classes(frame(spark, data).limit(0)).count() == 0
    nothing = [(1, None, 1), (2, [0.0], 1), (3, [1.0], None)]
    assert result(rangejoin.range_classes(frame(spark, nothing))) == plain(nothing)
