from __future__ import annotations

import random
import zlib

import numpy as np

from shiftledger.llm import quality
from shiftledger.llm.boosting import fit
from tests.llm.odd import documents, rows, text_of


def junk(rng: random.Random, words: int) -> str:
    return " ".join([text_of(rng, 1).upper() + "!!"] * words)


def labelled(spark, n=240):
    rng = random.Random(2)
    data = [(i, junk(rng, 30) if i % 3 == 0 else text_of(rng, rng.randint(20, 90))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    return data, labels


def test_held_out_documents_are_told_apart(spark):
    data, labels = labelled(spark)
    found = quality.quality(documents(spark, data), labels).collect()
    assert len(found) == len(data)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == int(r.doc_id % 3 != 0)


def test_held_out_labels_are_never_used(spark):
    data, labels = labelled(spark)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    frame = documents(spark, data)
    scores = [{r.doc_id: r.score for r in quality.quality(frame, x).collect()} for x in (labels, other)]
    assert scores[0] == scores[1]


def test_odd_documents_and_empty_tables(spark):
    data, labels = labelled(spark)
    frame = documents(spark, rows())
    found = quality.quality(frame, labels)
    assert found.count() == frame.count() and found.where("score is null or isnan(score)").count() == 0
    kept = quality.of_quality(frame, labels)
    assert kept.columns == frame.columns
    assert quality.quality(frame.limit(0), labels).count() == 0
    none = quality.quality(documents(spark, data), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}


def test_statistics_of_texts():
    assert not quality.statistics(b"").any() and not quality.statistics(b" \n ").any()
    assert np.isfinite(quality.statistics("é".encode() * 100_000)).all()


def test_flattened_trees_give_what_the_fit_saw():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = fit(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.start
        for t in range(len(model.value)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - model.feature.shape[1]]
        return total

    assert np.allclose(model.log_odds(x[:50]), [walk(r) for r in x[:50]])
    assert np.allclose(fit(x, np.ones(2000)).probability(x[:3]), 2000.5 / 2001)
