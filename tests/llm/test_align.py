from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shiftledger.llm import align
from tests.llm.odd import documents, result, rows, text_of

A, B = public_tokenizers.path(align.BYTE_LEVEL), public_tokenizers.path(align.PIECES)


def plain_sides(text):
    """Tokens of both sides as (id, end offset), or none."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    for given in text:
        if not given:
            yield None
            continue
        a = [(i, bytes(table[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + given, add_special_tokens=False).ids]
        b = [(i, bytes_b(i)) for i in model.encode(given)]
        whole = (" " + given).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            yield None
            continue
        sides = []
        for side in (a, b):
            end, out = 0, []
            for i, x in side:
                end += len(x)
                out.append((i, end))
            sides.append(out)
        yield sides


def plain(data):
    groups = []
    for sides in plain_sides([t for _, t in data]):
        if sides is None:
            groups.append([])
            continue
        both = {e for _, e in sides[0]} & {e for _, e in sides[1]}
        cut = []
        for side in sides:
            cut.append([[]])
            for i, end in side:
                cut[-1][-1].append(i)
                if end in both:
                    cut[-1].append([])
        groups.append(list(zip(cut[0][:-1], cut[1][:-1], strict=True)))
    links = [Counter((x, y) for a, b in cut for x in a for y in b) for cut in groups]
    counts = Counter(p for of in links for p in of)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, _), cut, of in zip(data, groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in cut)
        n_best = sum(n for p, n in of.items() if counts[p] == best[p[0]])
        facts = (sum(len(a) for a, _ in cut), sum(len(b) for _, b in cut), len(cut), sum(of.values()), n_best)
        digest = hashlib.sha256(written.encode()).hexdigest() if cut else ""
        out.append((doc_id, *facts, sum(n * counts[p] for p, n in of.items()), digest))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(12)
    signs = ["a", "bc", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", "...", "1234", "é", "é", "日本", "ß", " ", "😀", "'s", "<s>", "<0x41>", "▁", "\0"]
    texts = ["".join(rng.choices(signs[:20], k=rng.randint(1, 40))) for _ in range(60)]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(20)]
    texts += ["\n", " ", "  ", "\n ", " \n", "a\n", "a ", "=" * 1001, "0" * 777, "a▁b", "<unk> </s> <|endoftext|>", "﻿x"]
    texts += ["".join(rng.choices("abcde", k=30_000)), "x" + " " * 12_000 + "y"]
    return [(1000 + i, t) for i, t in enumerate(texts)]


def test_alignments_like_brute_force(spark):
    data = rows() + odd_texts()
    assert result(align.alignments(documents(spark, data))) == plain(data)


def test_small_blocks_and_parts_change_nothing(spark):
    data = rows() + odd_texts()[:30]
    assert result(align.alignments(documents(spark, data), block=2000, part=300)) == plain(data)


def test_hot_texts_and_ties(spark):
    data = [(i, "the same short text again") for i in range(200)] + [(300 + i, f"number {i} the text") for i in range(40)]
    assert result(align.alignments(documents(spark, data), block=500)) == plain(data)


def test_empty_table(spark):
    none = documents(spark, rows()[:1]).limit(0)
    assert align.alignments(none).count() == 0
    assert result(align.alignments(documents(spark, [(1, None), (2, "")]))) == plain([(1, None), (2, "")])


def test_parts_are_whole_and_start_anew():
    text = text_of(random.Random(3), 3000).encode()
    parts = align.parts_of(text, 200)
    assert b"".join(parts) == b" " + text and max(map(len, parts)) < 250
    assert align.parts_of(b"x" * 1000, 100) == [b" " + b"x" * 1000]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_the_model_is_cut_where_it_never_merges(size):
    pieces = align.Pieces(B, words=50)
    assert pieces.cuts
    texts = [" " + t for _, t in odd_texts() + rows() if t]
    for at in range(0, len(texts), size):
        some = texts[at : at + size]
        assert [x.tolist() for x in pieces.ids([t.encode() for t in some])] == pieces.model.encode([t[1:] for t in some])
