from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from shiftledger.llm import suffixes
from tests.llm.odd import documents, result, rows, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(data, window):
    texts = [(d, WORD.findall(t or "")) for d, t in data]
    count = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if count[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [suffixes.GROUP, 3])
def test_removals_like_brute_force(spark, group):
    data = rows()
    assert result(suffixes.removals(documents(spark, data), group=group)) == plain(data, 35)


def test_window_that_repeats_inside_one_text(spark):
    import random

    rng = random.Random(5)
    once, twice = text_of(rng, 40), text_of(rng, 35)
    data = [(1, f"{twice} {once} {twice}"), (2, text_of(rng, 34) + " end"), (3, "w " * 36), (4, "w " * 35)]
    assert result(suffixes.removals(documents(spark, data))) == plain(data, 35)


def test_texts_without_repeats_keep_the_rest(spark):
    data = rows()
    frame = documents(spark, data)
    found = suffixes.without_repeats(frame)
    assert found.columns == frame.columns and found.count() == frame.count()
    want = {d: (n, gone) for d, n, gone, _ in plain(data, 35) if d is not None}
    before = dict(data)
    for r in found.where("doc_id is not null").collect():
        n, gone = want[r.doc_id]
        assert len(WORD.findall(r.text or "")) == n - gone
        if not gone:
            assert r.text == before[r.doc_id]
        elif r.text is not None:
            assert r.n_chars == len(r.text)


def test_empty_table_and_narrow_window(spark):
    none = documents(spark, rows()[:1]).limit(0)
    assert suffixes.removals(none).count() == 0 and suffixes.without_repeats(none).count() == 0
    with pytest.raises(ValueError, match="more than"):
        suffixes.removals(none, window=24)
