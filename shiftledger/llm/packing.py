"""Packing of documents into training sequences by lexical retrieval.

Texts become token ids once, stored in the scratch folder. Document frequencies of all ids over the corpus (a table no
longer than the vocabulary) give BM25 its IDF. Each task reads its part of the token table in shards of about `shard`
tokens and indexes the ids that documents of the shard share. Whole windows of a long document stand alone; then a
seed document asks the index, with all of its ids, for its unused neighbours, best first, and they fill its window. The
one that does not fit is cut, and its rest is the next seed, so every sequence but a shard's last is full and no id is
lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, records, saved, text_bytes
from shiftledger.llm.tokens import encoder, vocabulary_path

WINDOW = 2048
SHARD = 2_000_000
K1, B = 1.2, 0.75
# An id in one of so many documents of a shard has a column in the matrix of weights.
MANY = 16
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def token_table(documents: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): ids of every text and the end id, as little-endian unsigned integers of four bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as encode:
            if np.iinfo(encode.kind).max < end:
                raise ValueError("the end id is larger than the vocabulary's ids")
            last = np.array([end], encode.kind).tobytes()
            for ids, texts in records(batches, 1024):
                yield batch_of(schema, ids, [x + last for x in encode.ids(texts)])

    rows = documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def frequencies(tokens: DataFrame, kind: np.dtype) -> tuple[np.ndarray, int, int]:
    """Documents by token id, all documents, all tokens. Tasks send one row per id at most."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, size = np.zeros(1 << 16, np.int64), 0, 0
        for (lists,) in records(batches, 512):
            for raw in lists:
                seen = np.zeros(1 << 16, bool) if kind.itemsize == 2 else None
                ids = np.frombuffer(raw, kind)
                documents, size = documents + 1, size + len(ids)
                if seen is not None:
                    seen[ids] = True
                    distinct = np.flatnonzero(seen)
                else:
                    distinct = np.unique(ids)
                if len(distinct) and distinct[-1] >= len(held):
                    held = np.concatenate((held, np.zeros(int(distinct[-1]) + 1 - len(held), np.int64)))
                held[distinct] += 1
        found = np.flatnonzero(held)
        yield batch_of(schema, np.concatenate(([-1, -2], found)), np.concatenate(([documents, size], held[found])))

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    df[ids[ids >= 0]] = n[ids >= 0]
    return df, int(n[ids == -1].sum()), int(n[ids == -2].sum())


class Index:
    """BM25 over the ids that documents of a shard share, one row of weights per document."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, average: float):
        lengths = np.array([len(d) for d in documents], np.int64)
        flat = np.concatenate(documents).astype(np.int64)
        owner = np.repeat(np.arange(len(documents), dtype=np.int64), lengths)
        cells, tf = np.unique(owner * len(idf) + flat, return_counts=True)
        document, term = cells // len(idf), cells % len(idf)
        # an id of one document alone links it to no other
        shared = (np.bincount(term, minlength=len(idf)) > 1)[term] & (idf[term] > 0)
        document, term, tf = document[shared], term[shared], tf[shared]
        norm = K1 * (1 - B + B * lengths[document] / average)
        self._weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        terms, self._term = np.unique(term, return_inverse=True)
        self._from, self._terms = np.searchsorted(document, np.arange(len(documents) + 1)), len(terms)
        self._hold(np.flatnonzero(np.diff(self._from)))

    def _hold(self, documents: np.ndarray) -> None:
        """Score these documents, which have a row, from now on: ids in many of them by a matrix of weights, the others
        by lists of documents."""
        sizes = self._from[documents + 1] - self._from[documents]
        at = np.arange(int(sizes.sum())) + np.repeat(self._from[documents] - np.cumsum(sizes) + sizes, sizes)
        row, term, weight = np.repeat(np.arange(len(documents)), sizes), self._term[at], self._weight[at]
        many = np.bincount(term, minlength=self._terms) * MANY >= len(documents)
        self._column = np.where(many, np.cumsum(many) - 1, -1)
        dense = many[term]
        self._matrix = np.zeros((len(documents), int(many.sum())))
        self._matrix[row[dense], self._column[term[dense]]] = weight[dense]
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self._row, self._listed = row[order], weight[order]
        self._list = np.searchsorted(term[order], np.arange(self._terms + 1))
        self._held = documents

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused documents that share an id with the seed, best score first, ties in shard order. With ``most`` at least
        so many, if there are. A document that was used once is not asked for again."""
        left = unused[self._held]
        if 2 * np.count_nonzero(left) < len(left):
            self._hold(self._held[left])
            left = left[left]
        if not len(left):
            return self._held
        own = self._term[self._from[seed] : self._from[seed + 1]]
        columns = self._column[own]
        asked = np.zeros(self._matrix.shape[1])
        asked[columns[columns >= 0]] = 1
        score = self._matrix @ asked
        own = own[columns < 0]
        if len(own):
            sizes = self._list[own + 1] - self._list[own]
            at = np.arange(int(sizes.sum())) + np.repeat(self._list[own] - np.cumsum(sizes) + sizes, sizes)
            score += np.bincount(self._row[at], self._listed[at], len(score))
        score = np.round(score, 9)  # of equal documents sums may differ in the last places
        at = np.flatnonzero((score > 0) & left)
        if most is not None and most < len(at):
            at = at[score[at] >= np.partition(score[at], -most)[-most]]
        return self._held[at[np.argsort(-score[at], kind="stable")]]


def pack(documents: list[np.ndarray], idf: np.ndarray, average: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every id of every document is in exactly one."""
    start = np.zeros(len(documents), np.int64)
    for i, ids in enumerate(documents):
        while len(ids) - start[i] >= window:
            yield [(i, int(start[i]), window)]
            start[i] += window
    left = np.array([len(d) for d in documents], np.int64) - start
    unused = left > 0
    if not unused.any():
        return
    index = Index(documents, idf, average)
    order = np.flatnonzero(unused)
    at, seed = 0, int(order[0])
    while True:
        unused[seed] = False
        pieces, space = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        ranked, rest = index.neighbours(seed, unused, space) if space else (), None
        take = iter(ranked)
        while space:
            nxt = next(take, None)
            if nxt is None:  # no neighbour is left: the next document in order
                while at < len(order) and not unused[order[at]]:
                    at += 1
                if at == len(order):
                    break
                nxt = order[at]
            if not unused[nxt]:
                continue
            part = min(int(left[nxt]), space)
            pieces.append((int(nxt), int(start[nxt]), part))
            start[nxt], left[nxt], space = start[nxt] + part, left[nxt] - part, space - part
            unused[nxt] = False
            if left[nxt]:
                rest = int(nxt)
        yield pieces
        if rest is not None:
            seed = rest
            continue
        while at < len(order) and not unused[order[at]]:
            at += 1
        if at == len(order):
            return
        seed = int(order[at])


def packed(documents: DataFrame, path: str | None = None, end: int = 1, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset (place in the sequence)
    and ids (those integers).

    Sequences have `window` ids but for the last of a shard. Null and empty texts are their end id; rows without doc_id
    and repeated rows are packed like others; an empty table gives no piece; other columns are ignored. path is a
    vocabulary of the tokenizers library.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    tokens = saved(token_table(documents, path, end), "tokens")
    with encoder(path) as encode:
        kind = encode.kind
    df, total, size = frequencies(tokens, kind)
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    average = size / max(total, 1)
    schema = pa.schema([(n, pa.int64()) for n in PIECES.replace(" long", "").split(", ")[:-1]] + [("ids", pa.binary())])

    def rows(ids: list, texts: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        out, number = [], first
        for number, pieces in enumerate(pack(texts, idf, average, window), first):
            offset = 0
            for i, start, length in pieces:
                raw = texts[i][start : start + length].astype("<u4").tobytes()
                out.append((ids[i], start, length, zlib.crc32(raw), len(texts[i]), number, offset, raw))
                offset += length
            if len(out) >= 512:
                yield batch_of(schema, *zip(*out, strict=True))
                out = []
        if out:
            yield batch_of(schema, *zip(*out, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0
        for doc_ids, lists in records(batches, 64):
            ids += doc_ids
            texts += [np.frombuffer(raw, kind) for raw in lists]
            held += sum(map(len, texts[-len(lists) :]))
            if held >= shard:
                yield from rows(ids, texts, number)
                number, ids, texts, held = number + (1 << 24), [], [], 0
        if ids:
            yield from rows(ids, texts, number)

    return tokens.mapInArrow(run, PIECES)
