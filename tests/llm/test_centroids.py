from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from shiftledger.llm import centroids
from tests.llm.odd import result

KINDS = "vec_id long, embedding array<double>, label int, cluster int, distance long, v int, cluster_inertia string"


def frame(spark, data):
    return spark.createDataFrame([(*d, 1, 2, 3, 4, "x") for d in data], KINDS).repartition(3)


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain(data, width, count, rounds):
    kept = []
    for vec_id, vector in data:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(1024 * x) for x in vector]))
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:count]]
    if not centres:
        return []

    def assigned():
        return [min((distance(v, c), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        number = [i for _, i in assigned()]
        for c in set(number):
            mine = [v for (_, v), i in zip(kept, number, strict=True) if i == c]
            centres[c] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    last = assigned()
    of = {c: sum(d for d, i in last if i == c) for _, c in last}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    rows = [(i, c, d, of[c], sum(of.values()), digest[c]) for (i, _), (d, c) in zip(kept, last, strict=True)]
    return sorted(rows, key=repr)


def vectors(width, n=260):
    rng = random.Random(4)
    blobs = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(5)]
    data = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(blobs)]) for i in range(n)]
    data += [(1000 + i, data[0][1]) for i in range(90)]  # copies hold a good part of all rows
    data += [data[5], data[5], (7, data[9][1]), (None, data[3][1]), (-20, [0.0] * width)]
    data += [(400, None), (401, []), (402, [0.5] * (width + 1)), (403, [None] * width), (404, [math.nan] * width)]
    data += [(405, [math.inf] + [0.0] * (width - 1)), (406, [40000.0, -40000.0] * (width // 2))]
    return data


@pytest.mark.parametrize("width", [4, 64])
def test_clusters_like_brute_force(spark, width):
    data = vectors(width)
    found = result(centroids.clustered(frame(spark, data), width=width))
    assert found == plain(data, width, 8, 10)


def test_large_components_are_exact(spark):
    data = [(i, [float(i) * 1e4, -9e3 * i, 0.25, 1e5 * (i % 7)]) for i in range(60)]
    assert result(centroids.clustered(frame(spark, data), width=4)) == plain(data, 4, 8, 10)


def test_ties_few_rows_and_no_rows(spark):
    same = [(i, [0.5, -0.5]) for i in range(20)]
    assert result(centroids.clustered(frame(spark, same), width=2)) == plain(same, 2, 8, 10)
    few = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])]
    assert result(centroids.clustered(frame(spark, few), width=2, count=2)) == plain(few, 2, 2, 10)
    assert centroids.clustered(frame(spark, few).limit(0), width=2).count() == 0
    assert centroids.clustered(frame(spark, [(None, [1.0, 2.0])]), width=2).count() == 0


def test_an_empty_cluster_keeps_its_centroid(spark):
    data = [(i, [float(i % 2), 0.0]) for i in range(30)]
    found = centroids.clustered(frame(spark, data), width=2, count=8)
    assert result(found) == plain(data, 2, 8, 10)
    assert {r.cluster for r in found.collect()} != set(range(8))


def test_search_rejects_most_centroids_unseen():
    rng = np.random.default_rng(2)
    centres = (rng.normal(0, 200, (200, 64)) + rng.normal(0, 400, (200, 1))).astype(np.int64)
    rows = (centres[rng.integers(0, 200, 500)] + rng.normal(0, 20, (500, 64))).astype(np.int64)
    search = centroids.Search(centres.tolist())
    number, best = search.nearest(rows)
    full = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (full.argmin(axis=1) == number).all() and (full.min(axis=1) == best).all()
    assert search.computed < 500 * 200 / 5
