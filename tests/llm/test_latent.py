from __future__ import annotations

import random

import numpy as np

from shiftledger.llm import latent
from tests.llm.odd import documents, rows, text_of


def corpus():
    rng = random.Random(4)
    items = [(i, text_of(rng, rng.randint(15, 60), "abcdefghijklmnop")) for i in range(12)]
    clean = [(i, text_of(rng, 150, "abcdefghijklmnop")) for i in range(60)]
    held = []
    for i, (_, text) in enumerate(items):
        held.append((100 + i, f"{text_of(rng, 90, 'abcdefghijklmnop')} {text.title()}, {text_of(rng, 70, 'abcdefghijklmnop')}"))
    words = items[3][1].split()
    kept = [w for j, w in enumerate(words) if j % 3 or j >= len(words) * 3 // 4]  # a third of the words is gone, not the answer
    held.append((200, f"{text_of(rng, 40, 'abcdefghijklmnop')} {' '.join(kept)} {text_of(rng, 40, 'abcdefghijklmnop')}"))
    return items, clean, held


def test_copies_and_paraphrases_are_found_and_clean_texts_are_not(spark):
    items, clean, held = corpus()
    benchmark = spark.createDataFrame([(*x, 1) for x in items] + [(50, None, 1), (51, "", 1)], "item_id long, text string, start int")
    found = latent.contaminated(documents(spark, clean + held), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(100 + i, i) for i in range(12)} | {(200, 3)}
    kinds = {r.doc_id: r.kind for r in found}
    assert kinds.pop(200) == "paraphrase" and set(kinds.values()) == {"copy"}
    assert all(r.common == r.n_words for r in found if r.kind == "copy")
    again = latent.contaminated(documents(spark, clean + held), benchmark, block=5).collect()
    assert {(r.doc_id, r.item_id) for r in again} == {(r.doc_id, r.item_id) for r in found}


def test_a_paraphrase_without_its_answer_is_left_alone(spark):
    items, clean, _ = corpus()
    words = items[3][1].split()
    part = " ".join(words[: int(len(words) * 0.7)])
    benchmark = spark.createDataFrame([(*items[3], "zzz yyy xxx")], "item_id long, text string, answer string")
    assert latent.contaminated(documents(spark, [*clean, (300, part)]), benchmark).count() == 0


def test_odd_documents_and_empty_tables(spark):
    items, clean, held = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, rows() + held)
    kept = latent.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    gone = {r.doc_id for r in frame.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {d for d, _ in held}
    assert latent.contaminated(frame, benchmark.limit(0)).count() == 0
    assert latent.contaminated(frame.limit(0), benchmark).count() == 0


def test_common_length_like_the_table():
    rng = np.random.default_rng(2)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert latent.common_length(a, b) == table(a.tolist(), b.tolist())


def test_directions_are_those_of_the_full_decomposition(spark):
    """With as many directions as terms the projection keeps every inner product."""
    items, clean, held = corpus()
    block = latent.read_items(spark.createDataFrame(items, "item_id long, text string"))
    codes = latent.coded(documents(spark, clean + held), block.vocabulary)
    df, total = latent.document_frequency(codes, len(block.vocabulary))
    texts = [set(latent.words_of(t.encode())) for _, t in clean + held]
    assert total == len(texts)
    assert all(df[c] == sum(w in t for t in texts) for w, c in block.vocabulary.items())
    idf, carries = latent.weights(block, df, total)
    slot = np.where(carries, np.cumsum(carries) - 1, -1)
    basis = latent.directions(codes, block, idf, slot, 10_000)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)


def plain_matches(items, data):
    """(doc_id, item_id, start, common, kind) by the longest common subsequence of every item with every window."""
    out = set()
    for doc_id, text in data:
        words = latent.words_of((text or "").encode())
        for item_id, held in items:
            own = latent.words_of(held.encode())
            width = max(32, 1 << int(np.ceil(np.log2(len(own) * 4 / 3))))
            codes = {w: i + 1 for i, w in enumerate(dict.fromkeys(own))}
            doc, item, best = np.array([codes.get(w, 0) for w in words]), np.array([codes[w] for w in own]), None
            answer = item[len(item) - max(1, len(item) // 4) :]
            for start in latent._windows(len(doc), width).tolist():
                part = doc[start : start + width]
                common = latent.common_length(item, part)
                kind = "copy" if common >= 0.8 * len(item) else None
                if not kind and common >= 0.5 * len(item) and latent.common_length(answer, part) >= 0.5 * len(answer):
                    kind = "paraphrase"
                if kind and (best is None or common > best[1]):
                    best = start, common, kind
            if best:
                out.add((doc_id, item_id, *best))
    return out


def test_an_item_in_a_third_of_the_rows_is_found_like_by_a_plain_search(spark):
    """Hot items, items of few distinct words and half-kept items are all found, with the best window."""
    rng = random.Random(6)
    word = lambda: text_of(rng, 1, "abcdefghijklmnop")
    items = [(i, text_of(rng, rng.randint(49, 59), "abcdefghijklmnop")) for i in range(4)]
    items.append((4, " ".join(w for _ in range(7) for w in ("one", "two", "three", "one", "four"))))
    data = []
    for i in range(240):
        texts = [text_of(rng, rng.randint(20, 400), "abcdefghijklmnop"), text_of(rng, rng.randint(0, 200), "abcdefghijklmnop")]
        if i % 3 == 0:
            own = items[i // 3 % 2][1].split()
            share = rng.choice([0, 0, 0.1, 0.2, 0.3, 0.45])
            texts.insert(1, " ".join(word() if rng.random() < share else w for w in own))
        elif i % 10 == 1:
            texts.insert(1, items[2 + i // 10 % 3][1])
        data.append((i, " ".join(texts)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.start, r.common, r.kind) for r in latent.contaminated(documents(spark, data), benchmark).collect()}
    want = plain_matches(items, data)
    assert found == want and len(want) > 90
