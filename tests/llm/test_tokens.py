from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shiftledger.llm import grammar, packing, tokens
from shiftledger.llm.tokens import Encoder, vocabulary_path
from tests.llm.odd import documents, rows, text_of

PIECES = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'S", ".", "1", "!", "é", "É", "\u00a0", "\u3000", "\x1c", "…", "\u0301", "ß", "\x00"]
PIECES += ["<|endoftext|>", "<|ENDOFTEXT|>", "日", "word", "Word,", "K", "ﬁ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_the_library(name):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=30)) for _ in range(1500)] + [t or "" for _, t in rows()]
    ours, library = Encoder(vocabulary_path(name), words=50), Tokenizer.from_file(vocabulary_path(name))
    found = ours.ids([t.encode() for t in texts])
    for text, raw in zip(texts, found, strict=True):
        assert np.frombuffer(raw, ours.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def plain_ids(name: str, data, end: int):
    library = Tokenizer.from_file(vocabulary_path(name))
    return [(d, library.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in data]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    data = rows()
    want, start = [], 0
    order = sorted(plain_ids("word_bpe_49k.json", data, 2), key=lambda x: (x[0] is not None, x[0] or 0))
    for doc_id, ids in order:
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    found = [tuple(r) for r in grammar.encoded(documents(spark, data), block=5000).orderBy("start").collect()]
    null = lambda got: sorted((r[2:] for r in got if r[0] is None), key=repr)  # noqa: E731  their order is open
    assert null(found) == null(want) and [r for r in found if r[0] is not None] == [r for r in want if r[0] is not None]
    assert grammar.encoded(documents(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 16, 1 << 18])
def test_grammar_expands_to_its_input(limit):
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 300, rng.integers(2, 9)) for _ in range(40)]
    docs = [np.concatenate([phrases[i] for i in rng.integers(0, 40, rng.integers(1, 30))]) for _ in range(60)]
    docs += [np.zeros(0, np.int64), np.full(999, 5), np.array([1])]
    ends = np.cumsum([len(d) for d in docs])
    symbols, stops, left, right = grammar.compress(np.concatenate(docs), ends, 300, limit=limit)
    assert len(symbols) < 0.6 * ends[-1] and len(left)
    texts = grammar.expansions(left, right, grammar.terminals(300))
    begin = 0
    for doc, stop in zip(docs, stops, strict=True):
        assert b"".join(texts[s] for s in symbols[begin:stop].tolist()) == doc.astype("<u4").tobytes()
        begin = max(begin, stop)
    block = grammar.Block(grammar.write_block(3, 4, [None, *range(1, len(docs))], np.concatenate(docs), ends, 300))
    assert (block.task, block.number, block.doc_ids[:2]) == (3, 4, [None, 1])
    for i, doc in enumerate(docs):
        assert [block.id_at(i, j) for j in range(len(doc))] == doc.tolist()
        with pytest.raises(IndexError):
            block.id_at(i, len(doc))


def test_copies_shrink_to_a_few_symbols_each():
    """Rounds go on to the end, so a passage becomes a symbol however long it is."""
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 300, 500).astype("<u2")
    flat, ends = np.tile(passage, 400), np.arange(1, 401) * 500
    symbols, stops, left, right = grammar.compress(flat, ends, 300)
    assert len(symbols) == 400 and stops.tolist() == list(range(1, 401))
    assert grammar.expansions(left, right, grammar.terminals(300))[int(symbols[0])] == passage.astype("<u4").tobytes()


def test_no_frequent_pair_remains_while_symbols_are_free():
    rng = np.random.default_rng(3)
    flat = rng.zipf(1.5, 20_000).clip(0, 250).astype("<u2")
    symbols, _, left, _ = grammar.compress(flat, np.array([20_000]), 300)
    pairs, counts = np.unique(np.stack((symbols[:-1], symbols[1:])), axis=1, return_counts=True)
    equal = pairs[0] == pairs[1]  # a run of one symbol has overlapping pairs, of which every other one can be replaced
    assert len(left) > 300 and counts[~equal].max() < grammar.LEAST and counts[equal].max(initial=0) < 2 * grammar.LEAST


def test_pairs_are_found_whatever_place_their_hash_has():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 1 << 32, 60_000, dtype=np.uint64).astype(np.uint32))
    keys = np.concatenate((pairs, rng.integers(0, 1 << 32, 60_000, dtype=np.uint64).astype(np.uint32)))
    fits, rule = grammar._numbered(pairs, keys)
    assert (fits == np.isin(keys, pairs)).all() and (pairs[rule[fits]] == keys[fits]).all()
    assert fits[: len(pairs)].all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_have_the_ids_of_the_library(name):
    encode = tokens.Encoder(tokens.vocabulary_path(name))
    assert encode.merged is not None
    rng = random.Random(6)
    small = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(rng.choice((small, "aeo", "lsß", small + "éèöüåæøßñçàÿþ")), k=rng.randint(1, 25))) for _ in range(20_000)]
    words += [c * n for c in "aesßé" for n in range(1, 40)] + ["a" * 5000]
    if not encode.drops_space:
        words = [w if rng.random() < 0.5 else " " + rng.choice((w, w.upper().replace("SS", "s"))) for w in words]
    fast = [encode._word(w.encode()) for w in words]
    assert fast == [encode._whole(w.encode()) for w in words]


def test_pieces_cover_every_id_once(spark):
    data = rows() + [(1000 + i, text_of(random.Random(i), 300)) for i in range(40)]
    found = packing.packed(documents(spark, data), window=256, shard=5000).collect()
    want = {}
    for doc_id, ids in plain_ids("byte_bpe_50k.json", data, 1):
        want.setdefault(doc_id, []).append(ids)
    cut, sequences = {}, {}
    for r in found:
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length
        cut.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (doc_id, size), pieces in cut.items():
        same = [ids for ids in want[doc_id] if len(ids) == size]
        flat = sum((ids for _, ids in sorted(pieces)), []) if len(same) == 1 else None
        assert sum(len(ids) for _, ids in pieces) == size * len(same)
        assert flat is None or flat == same[0]
    assert {d for d, _ in cut} == set(want)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in p) < 256 for p in sequences.values()) <= 3 + sum(r.length for r in found) // 5000
    assert packing.packed(documents(spark, data).limit(0)).count() == 0


def test_seeds_are_filled_with_their_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * t, 100 * t + 100, (8, 40)) for t in range(5)]
    docs = [topics[t][i] for i in range(8) for t in range(5)]
    sequences = list(packing.pack(docs, np.ones(500), 40, 160))
    assert len(sequences) == 10 and all(len({d % 5 for d, _, _ in s}) == 1 for s in sequences)


def test_scores_are_bm25():
    docs = [np.array(x) for x in ([1, 2, 2, 3], [2, 3, 3], [1, 4, 4, 4, 4], [5])]
    idf = np.array([0, 1.5, 0.5, 0.9, 2.0, 3.0])
    index = packing.Index(docs, idf, 3.25)

    def score(seed, other):
        total = 0.0
        for term in set(docs[seed].tolist()):
            tf = (docs[other] == term).sum()
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[other]) / 3.25)
            total += idf[term] * tf * (packing.K1 + 1) / (tf + norm)
        return total

    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == sorted([1, 2], key=lambda d: -score(0, d))
    assert not len(index.neighbours(3, np.ones(4, bool)))


def test_copies_of_common_ids_are_neighbours():
    """A group of copies whose ids all are in many documents, and one that shares its last ids only."""
    rng = np.random.default_rng(7)
    copy = rng.integers(0, 40, 30)
    docs = [copy if i % 10 == 0 else rng.integers(40, 400, 30) for i in range(100)]
    flat = [set(d.tolist()) for d in docs]
    df = np.array([sum(t in d for d in flat) for t in range(400)])
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    sequences = list(packing.pack(docs, idf, 30, 300))
    assert [sorted(d for d, _, _ in s) for s in sequences if any(d % 10 == 0 for d, _, _ in s)] == [list(range(0, 100, 10))]
    many = np.arange(20)
    index = packing.Index([many, many[-1:], np.array([25])], np.linspace(2, 1, 30), 10)
    assert index.neighbours(0, np.array([False, True, True])).tolist() == [1]


def test_common_ids_find_copies_in_the_corpus(spark):
    """Forty copies of one text among 400 documents: their ids are in a tenth of the corpus."""
    same = text_of(random.Random(1), 60)
    data = [(i, same if i % 10 == 0 else " ".join(f"q{i}x{j}" for j in range(40))) for i in range(400)]
    table = documents(spark, data).coalesce(1)
    found = packing.packed(table, window=1024).collect()
    of = {}
    for r in found:
        of.setdefault(r.sequence_id, set()).add(r.doc_id % 10 == 0)
    copies = sum(r.length for r in found if r.doc_id % 10 == 0)
    assert sum(True in kinds for kinds in of.values()) <= copies // 1024 + 2


def test_neighbours_are_best_first_while_documents_are_used():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, rng.integers(0, 25)) for _ in range(80)]
    idf, unused = rng.random(60) + 0.1, np.array([len(d) > 0 for d in docs])
    index = packing.Index(docs, idf, 12.0)

    def score(seed, other):
        total = 0.0
        for term in np.unique(docs[seed]):
            tf = (docs[other] == term).sum()
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[other]) / 12.0)
            total += idf[term] * tf * (packing.K1 + 1) / (tf + norm)
        return total

    for seed in rng.permutation(np.flatnonzero(unused)):
        unused[seed] = False
        want = sorted((d for d in np.flatnonzero(unused) if score(seed, d) > 0), key=lambda d: -round(score(seed, d), 9))
        assert index.neighbours(int(seed), unused).tolist() == want
        assert index.neighbours(int(seed), unused, 3).tolist()[:3] == want[:3]
