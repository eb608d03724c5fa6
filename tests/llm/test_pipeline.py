from __future__ import annotations

import random
import zlib

import corpus_pipeline
from shiftledger.llm import simhash, suffixes
from tests.llm.odd import documents, rows, text_of
from tests.llm.test_quality import junk
from tests.llm.test_suffixes import plain
from tests.test_plans import plan


def test_stages_on_planted_documents(spark, tmp_path):
    """Every stage does its part, and clean documents come through whole."""
    rng = random.Random(9)
    letters = "abcdefghijklmnop"
    clean = [(i, text_of(rng, 80, letters)) for i in range(1, 91)]
    bad = [(200 + i, junk(rng, 40)) for i in range(30)]
    copies = [(400, clean[0][1]), (401, clean[1][1] + " ")]
    passage = text_of(rng, 55, letters)
    repeats = [(500 + i, f"{text_of(rng, 50, letters)} {passage} {text_of(rng, 50, letters)}") for i in range(3)]
    item = text_of(rng, 30, letters)
    leak = [(600, f"{text_of(rng, 50, letters)} {item} {text_of(rng, 50, letters)}")]
    data = clean + bad + copies + repeats + leak
    folder = f"file://{tmp_path}"
    documents(spark, data).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda frame: {r.doc_id for r in frame.collect()}
    first = corpus_pipeline.keep_quality(spark, docs, folder)
    assert ids(first) == {i for i, _ in data} - {i for i, _ in bad}
    second = corpus_pipeline.keep_one_of_near_duplicates(spark, first, folder)
    assert ids(second) == ids(first) - {400, 401}
    third = corpus_pipeline.cut_repeated_passages(spark, second, folder)
    left = {i: t for i, t in data if i in ids(second)}
    gone = {d: n for d, _, n, _ in plain(list(left.items()), 35)}
    for r in third.collect():
        assert len(r.text.split()) == len(left[r.doc_id].split()) - gone[r.doc_id]
        assert (gone[r.doc_id] >= 55) == (500 <= r.doc_id < 503)
    fourth = corpus_pipeline.drop_contaminated(spark, third, folder)
    assert ids(fourth) == ids(third) - {600} and fourth.columns == docs.columns
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == ids(fourth)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def stored(spark, folder, data, labels):
    documents(spark, data).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = [(1, "no document holds any of these words at all")]
    spark.createDataFrame(item, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns pass every stage."""
    data = rows()
    ids = sorted({i for i, _ in data if i is not None})
    folder = f"file://{tmp_path}"
    stored(spark, folder, data, [(i, 1, None) for i in ids] + [(None, 0, 1), (ids[0], None, None), (10**6, 0, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        before = after
    kept = {r.doc_id for r in before.collect()}
    assert None in kept and len(kept) > 25
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == kept and all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed)


def test_near_duplicates_are_those_of_the_simhash_operator(spark, tmp_path):
    data = rows()
    docs = documents(spark, data)
    left = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    groups = simhash.near_duplicates(docs).where("doc_id = component_id")
    assert {r.doc_id for r in left.collect()} - {None} == {r.doc_id for r in groups.collect()}


def test_stages_broadcast_no_table_sized_by_its_files(spark, monkeypatch):
    """Decisions on repeated rows, repeated anchors and lists of anchors hold far more than their files."""
    rng = random.Random(4)
    passage = text_of(rng, 50)
    data = [(i, f"{text_of(rng, 40)} {passage}") for i in range(3)]
    docs = documents(spark, data + data[:2])
    left = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == data and "Broadcast" not in plan(left)
    plans = {}
    monkeypatch.setattr(suffixes, "saved", lambda frame, name, keep=suffixes.saved: plans.update({name: plan(frame)}) or keep(frame, name))
    cut = corpus_pipeline.cut_repeated_passages(spark, left, "")
    assert all(passage not in r.text for r in cut.collect())
    assert "SortMergeJoin [anchor" in plans["hits"] and "Broadcast" not in plans["hits"]
    assert "SortMergeJoin [tid" in plans["held"]


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    stored(spark, folder, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
