"""Alignment of two tokenizers on the same texts, and how often their tokens meet in the corpus.

Tokens of both sides are put on the byte offsets of space and text. pandas' merge_asof, keyed by document, gives each
token start the other side's covering token; the union of both directions are the overlaps, and overlaps with equal ends
close a group. All tokens of a group are linked with all of its other side.

An id pair counts once for each document that links it. Documents are dealt to blocks of a few megabytes of text. A
block lists its distinct pairs and in how many of its documents they occur, so a pair that occurs everywhere takes one
row for each block, not for each document. Counts of the corpus go back to the blocks that asked, and a document adds up
its links over its block's list. The table of pairs is never broadcast, and no key of a join or group is hot.

Long texts are tokenized and aligned in parts cut at a space between ASCII letters or digits, where both tokenizers
start anew; only a text without such a space is held as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, drop_saved, records, saved, text_bytes
from shiftledger.llm.tokens import vocabulary_path

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of text of a block, and of the parts that are aligned at once.
BLOCK = 4 << 20
PART = 1 << 20
_CUT = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_STARTS = re.compile(rb"(?=\n)|(?<=[^ ])(?= )")
#: Parts that the memo of a model holds before it starts anew.
_PIECE_WORDS = 200_000
#: Words and runs of spaces from this length on are left to the tokenizers library.
_LONG = 10_000
_GAP = b" " * _LONG
#: Groups with more links than this are folded by ids before they are multiplied out.
_SMALL = 64


class Pieces:
    """ids(texts) for a SentencePiece model, with a memo of the parts between which it never merges.

    Texts start with a space, which is the one that the model would add.
    """

    def __init__(self, path: str, words: int = _PIECE_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        texts = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [
            bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)
        ]
        self.space = self.model.piece_to_id("▁")
        # with a merge over a line end, or into a space from its left, only whole texts can be encoded
        self.cuts = not any("\n" in t or "▁" in t.lstrip("▁") for t in texts)
        # nor can parts, if white space is dropped or joined
        whole, end, word = self._plain(["\n  a ", "\n", " a"])
        self.cuts = self.cuts and whole == end + word + [self.space]
        self.words: dict[bytes, bytes] = {}
        self.limit = words

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in parts]
        # without its first space, which the model adds; before a line end that space is a token of its own
        found = self._plain([t if t[0] == "\n" else t[1:] for t in texts])
        cut = [ids[1:] if t[0] == "\n" else ids or [self.space] for t, ids in zip(texts, found, strict=True)]
        return [array("I", ids).tobytes() for ids in cut]

    def _known(self, parts: list[bytes]) -> list[bytes]:
        new = [p for p in parts if p not in self.words]
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
            new = parts
        self.words.update(zip(new, self._parts(new), strict=True))
        return list(map(self.words.__getitem__, parts))

    def _cut(self, text: bytes) -> bytes:
        """The text with a mark before each line end and before each run of spaces, but not before the first byte."""
        if b"  " in text:
            return _STARTS.sub(b"\0", text)
        return text[:1] + text[1:].replace(b" ", b"\0 ").replace(b"\n", b"\0\n")

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out = [np.empty(0, np.uint32)] * len(texts)
        at = []
        for i, text in enumerate(texts):
            if not self.cuts or b"\0" in text:
                out[i] = np.array(self._plain([text[1:].decode()])[0], np.uint32)
            else:
                at.append(i)
        if at:
            split = pc.split_pattern(pa.array([self._cut(texts[i]) for i in at], pa.large_string()), "\0")
            parts = split.flatten().dictionary_encode()
            known = self._known(parts.dictionary.cast(pa.large_binary()).to_pylist())
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            codes = parts.indices.to_numpy()
            ids = _gathered(np.frombuffer(b"".join(known), np.uint32), sizes, codes)
            ends = np.concatenate(([0], np.cumsum(sizes[codes])))[split.offsets.to_numpy()]
            for i, a, b in zip(at, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        return out


def _gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The entries `codes` of a table stored flat, one after the other."""
    length = sizes[codes]
    place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(length) - length), length)
    place += np.arange(len(place))
    return flat[place]


class ByteLevel:
    """ids(texts) for a byte-level vocabulary, without special tokens.

    tiktoken gives the ids of the file's own library in a sixth of the time, as every merge makes the next id and every
    entry but the bytes and special tokens is a merge, which is checked. Its stack does not bear very long words, so texts
    with one go to that library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.entries = byte_level_entries(vocabulary | added)
        made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        ranked = made == list(range(256, 256 + len(merges))) and len(vocabulary.keys() - added.keys()) == 256 + len(merges)
        plain = content["normalizer"] is None and content["pre_tokenizer"].get("use_regex")
        self.ranks = None
        if ranked and plain and not content["pre_tokenizer"]["add_prefix_space"]:
            ranks = {x: i for i, x in enumerate(self.entries) if i not in added.values()}
            pattern = public_tokenizers.PATTERN
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.ranks is not None and max(map(len, text.split(b" "))) < _LONG and _GAP not in text:
                out.append(self.ranks.encode_to_numpy(text.decode(), disallowed_special=()))
            else:
                out.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32))
        return out


class Vocabulary:
    """Bytes of a vocabulary's entries, stored flat."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return _gathered(self.flat, self.sizes, ids).tobytes()


def byte_level_entries(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of the entries of a byte-level vocabulary, which writes every byte as one character."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    entries = [b""] * (max(vocabulary.values()) + 1)
    for text, i in vocabulary.items():
        entries[i] = bytes(map(table.__getitem__, text)) if all(c in table for c in text) else text.encode()
    return entries


class Aligned:
    """The alignment of some texts: arrays by text, links by text and id pair, and the groups written out."""

    def __init__(self, fine, n_a, n_b, n_groups, n_links, written, text, pair, times):
        self.fine, self.n_a, self.n_b, self.n_groups, self.n_links = fine, n_a, n_b, n_groups, n_links
        self.written, self.text, self.pair, self.times = written, text, pair, times


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        self.encode_a = ByteLevel(byte_level)
        self.encode_b = Pieces(pieces)
        self.a = Vocabulary(self.encode_a.entries)
        self.b = Vocabulary(self.encode_b.bytes)
        self.bits = len(self.b.sizes).bit_length()
        # every id as text, with the mark that follows it inside and at the end of its side of a group
        self.marks = [f"{i}{m}".encode() for i in range(len(self.a.sizes)) for m in ",|"]
        self.marks += [f"{i}{m}".encode() for i in range(len(self.b.sizes)) for m in ",;"]

    def pair(self, a, b):
        return (a << self.bits) | b

    def aligned(self, texts: list[bytes]) -> Aligned:
        """Alignment of texts that start with a space."""
        ids_a = self.encode_a.ids(texts)
        ids_b = self.encode_b.ids(texts)
        fine = np.array(
            [t == self.a.joined(x) and t == self.b.joined(y) for t, x, y in zip(texts, ids_a, ids_b, strict=True)], bool
        )
        count = len(texts)
        n_a = np.array([len(x) if f else 0 for x, f in zip(ids_a, fine, strict=True)], np.int64)
        n_b = np.array([len(x) if f else 0 for x, f in zip(ids_b, fine, strict=True)], np.int64)
        a = np.concatenate([np.empty(0, np.int64)] + [x for x, f in zip(ids_a, fine, strict=True) if f]).astype(np.int64)
        b = np.concatenate([np.empty(0, np.int64)] + [x for x, f in zip(ids_b, fine, strict=True) if f]).astype(np.int64)
        text_a, text_b = np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)
        shut_a, shut_b = self._closing(a, text_a, b, text_b)
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        groups = int(shut_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        text = text_a[first_a] if groups else np.empty(0, np.int64)
        n_links = np.zeros(count, np.int64)
        np.add.at(n_links, text, size_a * size_b)
        at, pair, times = self._links(a, b, text, size_a, size_b, first_a, first_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[group_a]] = 2 * a + shut_a
        codes[np.arange(len(b)) + (first_a + size_a)[group_b]] = 2 * (len(self.a.sizes) + b) + shut_b
        marked = list(map(self.marks.__getitem__, codes.tolist()))
        ends = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        written = [b"".join(marked[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
        return Aligned(fine, n_a, n_b, np.bincount(text, minlength=count), n_links, written, at, pair, times)

    def _closing(self, a, text_a, b, text_b) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of either side end together with one of the other."""
        end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        left = pd.DataFrame({"start": end_a - self.a.sizes[a], "text": text_a, "a": np.arange(len(a))})
        right = pd.DataFrame({"start": end_b - self.b.sizes[b], "text": text_b, "b": np.arange(len(b))})
        over = pd.merge_asof(left, right, on="start", by="text")
        under = pd.merge_asof(right, left, on="start", by="text")
        met_a = np.concatenate((over["a"].to_numpy(), under["a"].to_numpy()))
        met_b = np.concatenate((over["b"].to_numpy(), under["b"].to_numpy()))
        together = end_a[met_a] == end_b[met_b]
        shut_a, shut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        shut_a[met_a[together]] = 1
        shut_b[met_b[together]] = 1
        return shut_a, shut_b

    def _links(self, a, b, text, size_a, size_b, first_a, first_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): how many links each text has of each id pair."""
        product = size_a * size_b
        small = np.flatnonzero(product <= _SMALL)
        each = product[small]
        group = np.repeat(small, each)
        step = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        pairs = [self.pair(a[first_a[group] + step // size_b[group]], b[first_b[group] + step % size_b[group]])]
        texts, times = [text[group]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(product > _SMALL).tolist():
            some_a, count_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            some_b, count_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            pairs.append(self.pair(some_a[:, None], some_b[None, :]).ravel())
            times.append((count_a[:, None] * count_b[None, :]).ravel())
            texts.append(np.full(len(pairs[-1]), text[g]))
        return summed(np.concatenate(texts), np.concatenate(pairs), np.concatenate(times))


def summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal text and pair added up, in order of both."""
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    if not len(text):
        return text, pair, times
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))))
    return text[first], pair[first], np.add.reduceat(times, first)


def parts_of(text: bytes, size: int = PART) -> list[bytes]:
    """Space and text, cut where both tokenizers start anew, into parts of at least `size` bytes."""
    text = b" " + text
    cuts = [0]
    while len(text) - cuts[-1] > size and (found := _CUT.search(text, cuts[-1] + size)):
        cuts.append(found.start())
    return [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)], strict=True)]


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The aligner of this worker process."""
    held = sys.modules.setdefault("_llm_aligners", types.ModuleType("_llm_aligners"))
    name = f"{byte_level} {pieces}"
    if name not in vars(held):
        setattr(held, name, Aligner(byte_level, pieces))
    return vars(held)[name]


def aligned_block(align: Aligner, texts: list[bytes], size: int = PART) -> tuple[Aligned, list[str]]:
    """Alignment of whole texts, part by part, and the digests of their groups."""
    count = len(texts)
    totals = np.zeros((5, count), np.int64)
    fine = np.array([bool(t) for t in texts])
    digests = [hashlib.sha256() for _ in texts]
    links: list[list[np.ndarray]] = [[], [], []]
    waiting: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        of = np.array([i for i, _ in waiting], np.int64)
        part = align.aligned([p for _, p in waiting])
        fine[of[~part.fine]] = False
        for i, written in zip(of.tolist(), part.written, strict=True):
            # the mark after a document's last group is not part of it
            digests[i].update((b";" if totals[0, i] else b"") + written[:-1])
            totals[0, i] += bool(written)
        for total, found in zip(totals[1:], (part.n_a, part.n_b, part.n_groups, part.n_links), strict=True):
            np.add.at(total, of, found)
        for kept, found in zip(links, (of[part.text], part.pair, part.times), strict=True):
            kept.append(found)
        waiting.clear()

    for i, text in enumerate(texts):
        for piece in parts_of(text, size) if text else ():
            waiting.append((i, piece))
            held += len(piece)
            if held >= size:
                flush()
                held = 0
    if waiting:
        flush()
    text, pair, times = summed(*(np.concatenate(x) if x else np.empty(0, np.int64) for x in links))
    kept = fine[text] if len(text) else np.empty(0, bool)
    totals[:, ~fine] = 0
    names = [d.hexdigest() if f else "" for d, f in zip(digests, fine.tolist(), strict=True)]
    return Aligned(fine, *totals[1:], [], text[kept], pair[kept], times[kept]), names


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as their lowest bytes, then their second ones, and so on, which compresses well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_FACTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")


def _blocks(documents: DataFrame, byte_level: str, pieces: str, block: int, part: int) -> DataFrame:
    """One row per document with its links, as places in the list of its block and how often; one row per block with
    that list (own) and in how many documents of the block each pair is linked (docs)."""
    schema = pa.schema(
        [("block", pa.int64())]
        + [(name, pa.int64()) for name in _FACTS]
        + [("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary())]
        + [("own", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []

        def rows() -> Iterator[pa.RecordBatch]:
            found, digests = aligned_block(align, texts, part)
            own, place = np.unique(found.pair, return_inverse=True)
            ends = np.searchsorted(found.text, np.arange(len(texts) + 1)).tolist()
            steps = [np.diff(place[a:b], prepend=0) for a, b in zip(ends, ends[1:], strict=False)]
            times = [_planes(found.times[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            facts = (found.n_a, found.n_b, found.n_groups, found.n_links)
            none = [None] * len(texts)
            yield batch_of(schema, [number] * len(texts), ids, *facts, digests, map(_planes, steps), times, none, none)
            docs = np.bincount(place, minlength=len(own))
            yield batch_of(schema, [number], *([None] for _ in range(8)), [own], [docs])

        try:
            held = 0
            for some_ids, some_texts in records(batches):
                for doc_id, text in zip(some_ids, some_texts, strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text)
                    if held >= block:
                        yield from rows()
                        number, held = number + 1, 0
                        ids.clear()
                        texts.clear()
            if texts:
                yield from rows()
        finally:
            align.encode_b.words.clear()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    kinds = "block long, " + ", ".join(f"{name} long" for name in _FACTS)
    return source.mapInArrow(run, f"{kinds}, groups_sha256 string, at binary, times binary, own array<long>, docs array<long>")


def pair_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether no pair of its A id has more."""
    listed = blocks.where("own is not null").select(F.inline(F.arrays_zip(F.col("own").alias("pair"), F.col("docs").alias("docs"))))
    counted = listed.groupBy("pair").agg(F.sum("docs").alias("n"))
    # an A id has at most as many pairs as the other vocabulary has ids
    of_a = Window.partitionBy(F.shiftright("pair", bits))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_a))


def alignments(
    documents: DataFrame, byte_level: str | None = None, pieces: str | None = None, block: int = BLOCK, part: int = PART
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of documents.

    A is a byte-level tokenizer on a space and the text, B a SentencePiece model on the text, to which it adds the
    space; both are paths of public files. Strings of special tokens are plain text. Texts that are null or empty, or
    that either side does not give back byte by byte, have no tokens: zeros and an empty digest. Each row is a document
    of its own, repeated ones and those with a null doc_id included. An empty table gives an empty result; other columns
    are ignored.
    """
    byte_level, pieces = byte_level or vocabulary_path(BYTE_LEVEL), pieces or vocabulary_path(PIECES)
    bits = Vocabulary(Pieces(pieces).bytes).sizes.size.bit_length()
    blocks = saved(_blocks(documents, byte_level, pieces, block, part), "aligned")
    counts = pair_counts(blocks, bits)
    places = blocks.where("own is not null").select(F.col("block").alias("asker"), F.posexplode("own").alias("place", "pair"))
    answered = places.join(counts, "pair").select("asker", "place", "n", "best")
    texts = blocks.where("own is null").drop("own", "docs")
    names = (*_FACTS, "n_best", "count_sum", "groups_sha256")
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in names])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place] = known.column("n").to_numpy()
        best[place] = known.column("best").to_numpy()
        n_best, count_sum = [], []
        for at, times in zip(rows.column("at").to_pylist(), rows.column("times").to_pylist(), strict=True):
            at, times = np.cumsum(_numbers(at)), _numbers(times)
            n_best.append(int((best[at] * times).sum()))
            count_sum.append(int((n[at] * times).sum()))
        facts = [rows.column(name).combine_chunks() for name in _FACTS]
        return pa.table([*facts, n_best, count_sum, rows.column("groups_sha256").combine_chunks()], schema=schema)

    kinds = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names)
    found = texts.groupBy("block").cogroup(answered.groupBy("asker")).applyInArrow(run, kinds)
    result = saved(found, "alignments")
    drop_saved(blocks)
    return result
