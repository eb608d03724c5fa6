from __future__ import annotations

import math
import random

import numpy as np
import pytest

from shiftledger.llm import impact
from tests.llm.odd import result


def plain(data, k=20, every=20):
    valid = []
    for vec_id, vector in data:
        fine = vector is not None and all(x is not None and math.isfinite(x) for x in vector)
        if fine and vec_id is not None:
            valid.append((vec_id, [math.floor(64 * x) for x in vector]))
    out = []
    for i, (query, q) in enumerate(valid):
        if query % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v, strict=False)), vec_id) for j, (vec_id, v) in enumerate(valid) if j != i]
            out += [(query, r, vec_id, -s) for r, (s, vec_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def vectors(n=300, width=16):
    rng = random.Random(6)
    data = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(width)]) for i in range(n)]
    data += [(400, data[20][1]), (401, data[20][1]), (420, [0.0] * width), (440, []), (441, [0.5, -0.5]), (460, data[0][1]), (460, data[0][1])]
    data += [(461, None), (480, [None] * width), (481, [math.nan] * width), (482, [math.inf] * width), (None, data[1][1]), (-20, data[3][1])]
    data += [(500, [4e7] + [0.0] * 15), (501, [40.0] * 16), (520, [-3e6, 2.5e6] + [0.1] * 14), (521, [7e6] * 16)]
    return data


def frame(spark, data):
    return spark.createDataFrame([(*d, 1, 2) for d in data], "vec_id long, embedding array<double>, score int, block int").repartition(3)


@pytest.mark.parametrize("block", [impact.BLOCK, 64])
def test_best_like_brute_force(spark, block):
    data = vectors()
    assert result(impact.top_k(frame(spark, data), block=block, queries=5)) == plain(data)


def test_ties_and_few_rows(spark):
    data = [(i, [0.5, 0.25]) for i in range(30)]
    assert result(impact.top_k(frame(spark, data))) == plain(data)
    data = data[:3]
    assert result(impact.top_k(frame(spark, data))) == plain(data)
    assert impact.top_k(frame(spark, data).limit(0)).count() == 0


def test_the_search_stops_on_proof():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 8, (4000, 64)).astype(np.int64)
    asked = rows[:32] + rng.normal(0, 1, (32, 64)).astype(np.int64)
    for query, (found, score) in zip(asked, impact.Index(rows).best(asked, 20), strict=True):
        full = rows @ query
        assert len(found) < 1000 and (full[found] == score).all()
        assert set(np.flatnonzero(full >= np.sort(full)[-20])) <= set(found.tolist())


def test_scores_up_to_a_long_are_exact_and_larger_ones_fail(spark):
    data = [(0, [2.0**25, 1.0]), (1, [2.0**25, 3.0]), (2, [2.0**25 + 1, -7.0]), (3, [-(2.0**40), 0.0]), (20, [0.0, 0.0])]
    want = plain(data)
    assert max(r[3] for r in want) > 1 << 60
    assert result(impact.top_k(frame(spark, data), k=2)) == [r for r in want if r[1] <= 2]
    for huge in ([1e300, 0.0], [2.0**33, 0.0]):
        with pytest.raises(Exception, match="fit a long"):
            impact.top_k(frame(spark, [*data, (40, huge), (41, huge)])).collect()


def test_infinities_after_scaling_are_no_infinite_components(spark):
    with pytest.raises(Exception, match="fit a long"):
        impact.top_k(frame(spark, [(0, [1.7e308]), (1, [1.0])])).collect()
