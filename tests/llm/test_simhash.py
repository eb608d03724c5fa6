from __future__ import annotations

import re

import xxhash

from shiftledger.llm import graph, simhash
from shiftledger.llm.graph import components
from tests.llm.odd import documents, result, rows
from tests.test_plans import plan


def plain_fingerprint(text: str | None) -> int:
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints: list[int]) -> list[int]:
    """Index of the first member of each one's class."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_like_brute_force(spark):
    data = rows()
    prints = [plain_fingerprint(t) for _, t in data]
    classes = plain_classes(prints)
    least = {}
    for (doc_id, _), c in zip(data, classes, strict=True):
        least[c] = min((x for x in (least.get(c), doc_id) if x is not None), default=None)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = sorted(((d, p, least[c]) for (d, _), p, c in zip(data, signed, classes, strict=True)), key=repr)
    assert result(simhash.near_duplicates(documents(spark, data))) == want


def test_links_find_every_pair_within_three_bits(spark):
    import random

    rng = random.Random(3)
    prints = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            near = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                near ^= 1 << bit
            prints.add(near)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = {tuple(r) for r in simhash.links(frame).collect()}
    want = {tuple(sorted((signed[p], signed[q]))) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= 3}
    assert found == want


def test_components_of_chains_cycles_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 8), (8, 7), (7, 8)] + [(1, 20 + i) for i in range(30)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 100 for i in range(100, 161)} | {7: 7, 8: 7} | {1: 1} | {20 + i: 1 for i in range(30)}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_that_grow_with_documents_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Their files are far below Spark's threshold here, as those of a middling corpus are. What they hold is not."""
    prints = [0, 1, 3, 1 << 40, (1 << 40) + 5, 1 << 20]
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(f"{tmp_path}/prints")
    met = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    assert {tuple(r) for r in met.collect()} == {(p, q) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= 3}
    assert "Broadcast" not in plan(met) and "SortMergeJoin" in plan(met)
    assert "Broadcast" not in plan(simhash.near_duplicates(documents(spark, rows())))

    spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    plans = []
    monkeypatch.setattr(graph, "saved", lambda frame, name, keep=graph.saved: plans.append(plan(frame)) or keep(frame, name))
    few = sorted(components(edges).collect())
    monkeypatch.setattr(graph, "FEW_EDGES", 1)
    plans.clear()
    assert sorted(components(edges).collect()) == few == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert len(plans) > 1 and not any("Broadcast" in text for text in plans)


def test_one_of_each_group_keeps_columns_and_nameless_rows(spark):
    data = rows()
    frame = documents(spark, data)
    kept = simhash.one_of_each_group(frame)
    assert kept.columns == frame.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    named = {r.doc_id for r in simhash.near_duplicates(frame).where("doc_id = component_id").collect()}
    assert [i for i in ids if i is not None] == sorted(named, key=repr)
    assert ids.count(None) == 2


def test_empty_table(spark):
    none = documents(spark, rows()[:1]).limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each_group(none).count() == 0
