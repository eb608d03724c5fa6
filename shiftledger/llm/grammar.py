"""Token-id files with Re-Pair grammar compression per block.

Documents are dealt by ranges of doc_id, put in order, encoded, and written in blocks of about `block` ids. In a block
the frequent pairs of neighbouring symbols are replaced by nonterminals, round after round: a round counts pairs, takes
the most frequent ones, and replaces them from left to right where they overlap. The first rounds share the free symbols
among them; from then on a round takes all frequent pairs, so that the next one need only look next to new symbols, and
rounds go on until no pair is frequent or no symbol is free. No pair spans two documents, so a document's symbols decode
without the others; rules carry their expansion lengths, so one id is found without expanding what precedes it.

A block, all integers little-endian:

    magic "IDG2", then unsigned 32-bit: task, number in the task, documents, rules, symbols, first nonterminal
    documents: doc_id (signed 64), 1 if doc_id is null (8), end of its symbols (unsigned 32), ids before and with it
    (unsigned 64)
    rules: left, right (as symbols), expansion length (unsigned 32); rule r is symbol first nonterminal + r
    symbols (unsigned 16 if they fit, else 32)

A newline follows each block. Blocks in order of task and number hold documents in ascending doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, read_bytes, records, saved, scratch_path, text_bytes, write_bytes
from shiftledger.llm.tokens import Encoder, encoder, vocabulary_path

BLOCK = 500_000
#: Rounds that share the free symbols. Those after them go on to the end.
SHARED = 2
LEAST = 8
BLOCKS_PER_FILE = 64
_HEAD = "<4s6I"


def _slot(keys: np.ndarray) -> np.ndarray:
    """Twenty bits of a multiplicative hash."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _numbered(pairs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are among the pairs, which are sorted and distinct, and at what place."""
    table = np.zeros(1 << 20, np.int32)
    slots = _slot(pairs)
    table[slots] = np.arange(len(pairs))
    rule = table[_slot(keys)]
    fits = pairs[rule] == keys
    lost = np.flatnonzero(table[slots] != np.arange(len(pairs)))  # another pair has their slot
    if len(lost):
        missed = np.flatnonzero(~fits)
        at = np.minimum(np.searchsorted(pairs[lost], keys[missed]), len(lost) - 1)
        found = pairs[lost][at] == keys[missed]
        rule[missed[found]] = lost[at[found]]
        fits[missed[found]] = True
    return fits, rule


def compress(ids: np.ndarray, ends: np.ndarray, first: int, shared: int = SHARED, least: int = LEAST, limit: int = 1 << 16):
    """Symbols, ends of the documents among them, and rules (left, right) of Re-Pair rounds.

    ids are all documents one after the other and ends where each stops; first is the first symbol that is no id.
    Symbols stay under `limit` if ids do.
    """
    limit = max(limit, first + 1)
    shift = 16 if limit <= 1 << 16 else 32  # two symbols are one key
    symbols = ids.astype(np.uint32 if shift == 16 else np.uint64)
    mask = symbols.dtype.type((1 << shift) - 1)
    step = symbols.dtype.type(shift)
    closes = np.zeros(len(symbols), bool)
    closes[ends[ends > 0] - 1] = True
    # an empty document closes nothing of its own
    empty = np.diff(np.concatenate(([0], ends))) == 0
    left_rules, right_rules, known = [], [], first
    done, fresh = 0, 0  # only symbols from `fresh` on can be in a frequent pair
    while known < limit and len(symbols) > 1:
        room = limit - known
        usable = ~closes[:-1]
        if fresh:
            new = symbols >= fresh
            usable &= new[:-1] | new[1:]
        else:
            often = np.bincount(symbols, minlength=known) >= least
            usable &= often[symbols[:-1]] & often[symbols[1:]]
        place = np.flatnonzero(usable)
        keys = (symbols[place] << step) | symbols[place + 1]
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else keys
        counts = np.diff(np.append(starts, len(keys)))
        chosen = np.flatnonzero(counts >= least)
        if not len(chosen):
            break
        share = -(-room // max(shared - done, 1))
        if len(chosen) > share:
            chosen = np.sort(chosen[np.argsort(-counts[chosen], kind="stable")[:share]])
        pairs = ordered[starts[chosen]]
        fits, rule = _numbered(pairs, keys)
        at, rule = place[fits], rule[fits]
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        order = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, rule = at[order % 2 == 0], rule[order % 2 == 0]
        symbols[at] = known + rule
        closes[at] = closes[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, closes = symbols[stays], closes[stays]
        left_rules.append((pairs >> step).astype(np.int64))
        right_rules.append((pairs & mask).astype(np.int64))
        done += 1
        fresh = known if done > shared else 0
        known += len(pairs)
    stops = np.zeros(len(ends), np.int64)
    stops[~empty] = np.flatnonzero(closes) + 1
    stops = np.maximum.accumulate(stops) if len(stops) else stops
    none = [np.zeros(0, np.int64)]
    return symbols, stops, np.concatenate(left_rules or none), np.concatenate(right_rules or none)


def terminals(first: int) -> list[bytes]:
    """Ids as four-byte integers."""
    return [struct.pack("<I", i) for i in range(first)]


def expansions(left: np.ndarray, right: np.ndarray, ids: list[bytes]) -> list[bytes]:
    """Ids of every symbol as four-byte integers. Rules only use symbols before them."""
    out = list(ids)
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        out.append(out[a] + out[b])
    return out


def write_block(task: int, number: int, doc_ids: list, ids: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    symbols, stops, left, right = compress(ids, ends, first)
    length = np.ones(first + len(left), np.int64)
    for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        length[first + r] = length[a] + length[b]
    wide = "<u2" if first + len(left) <= 1 << 16 else "<u4"
    return b"".join((
        struct.pack(_HEAD, b"IDG2", task, number, len(doc_ids), len(left), len(symbols), first),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        stops.astype("<u4").tobytes(),
        ends.astype("<u8").tobytes(),
        left.astype(wide).tobytes(), right.astype(wide).tobytes(), length[first:].astype("<u4").tobytes(),
        symbols.astype(wide).tobytes(),
    ))


class Block:
    """A block read back: documents(), and single ids by document and place."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.task, self.number, n, rules, symbols, self.first = struct.unpack_from(_HEAD, data, at)
        if magic != b"IDG2":
            raise ValueError("not a block of token ids")
        at += struct.calcsize(_HEAD)

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = read("<i8", n), read("u1", n)
        self.doc_ids = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist(), strict=True)]
        self.stops, self.ends = read("<u4", n).astype(np.int64), read("<u8", n).astype(np.int64)
        kind = "<u2" if self.first + rules <= 1 << 16 else "<u4"
        self.left, self.right, self.length = read(kind, rules), read(kind, rules), read("<u4", rules)
        self.symbols = read(kind, symbols)
        self.next = at + 1

    def documents(self, ids: list[bytes]) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, ids of the block before it, and its ids as four-byte integers. ids are terminals(self.first)."""
        texts = expansions(self.left, self.right, ids)
        symbols, begin, before = self.symbols.tolist(), 0, 0
        for doc_id, stop, end in zip(self.doc_ids, self.stops.tolist(), self.ends.tolist(), strict=True):
            yield doc_id, before, b"".join(map(texts.__getitem__, symbols[begin:stop]))
            begin, before = max(begin, stop), end

    def id_at(self, document: int, place: int) -> int:
        """The id at a place of the block's document, found by expansion lengths alone."""
        symbols = self.symbols[self.stops[document - 1] if document else 0 : self.stops[document]].astype(np.int64)
        lengths = np.where(symbols >= self.first, self.length[np.maximum(symbols - self.first, 0)] if len(self.length) else 1, 1)
        ends = np.cumsum(lengths)
        if not 0 <= place < (ends[-1] if len(ends) else 0):
            raise IndexError("the document has fewer ids")
        i = int(np.searchsorted(ends, place, side="right"))
        symbol, place = int(symbols[i]), place - int(ends[i] - lengths[i])
        while symbol >= self.first:
            left = int(self.left[symbol - self.first])
            size = int(self.length[left - self.first]) if left >= self.first else 1
            symbol, place = (left, place) if place < size else (int(self.right[symbol - self.first]), place - size)
        return symbol


def write_ids(documents: DataFrame, to: str, path: str, end: int, block: int = BLOCK) -> None:
    """Write the ids of every text and the end id, in ascending doc_id order (null first), below the folder `to`."""
    schema = pa.schema([("value", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch], encode: Encoder) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId(), encode.kind.itemsize
        last, first = np.array([end], encode.kind).tobytes(), max(encode.size, end + 1)
        ids, parts, held, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // size for p in parts])
            flat = np.frombuffer(b"".join(parts), encode.kind)
            return batch_of(schema, [write_block(task, number, ids, flat, ends, first)])

        for doc_ids, texts in records(batches, 512):
            ids += doc_ids
            parts += [x + last for x in encode.ids(texts)]
            held += sum(map(len, parts[-len(texts) :])) // size
            if held >= block:
                yield close()
                ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as encode:
            yield from blocks(batches, encode)

    rows = documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    write_bytes(dealt.mapInArrow(run, "value binary"), "value", to, "\n", BLOCKS_PER_FILE)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below the folder.

    start counts the ids of all documents before it: ids before it in its block, blocks before its own in the task,
    and tasks before its own. Only the last sum is over one window, of as many rows as tasks wrote.
    """
    kinds = "doc_id long, task long, number long, before long, n_tokens long, ids_crc32 long"
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "task", "number", "before", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        for _, contents in records(batches, 1):
            data, at = contents[0], 0
            while at < len(data):
                held = Block(data, at)
                ids = ids if len(ids) == held.first else terminals(held.first)
                rows = [
                    (doc_id, held.task, held.number, before, len(raw) // 4, zlib.crc32(raw))
                    for doc_id, before, raw in held.documents(ids)
                ]
                yield batch_of(schema, *zip(*rows, strict=True))
                at = held.next

    read = saved(read_bytes(spark, folder).mapInArrow(run, kinds), "documents")
    blocks = read.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    in_task = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("in_task", F.coalesce(F.sum("n").over(in_task), F.lit(0)))
    tasks = blocks.groupBy("task").agg(F.sum("n").alias("m"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("earlier"))
    start = (F.col("before") + F.col("in_task") + F.col("earlier")).alias("start")
    joined = read.join(blocks.join(tasks, "task"), ["task", "number"])
    return joined.select("doc_id", start, "n_tokens", "ids_crc32")


def encoded(documents: DataFrame, path: str | None = None, end: int = 2, block: int = BLOCK) -> DataFrame:
    """Write documents as token-id files in the scratch folder and read them back: see write_ids() and read_ids().

    Null and empty texts are their end id. Rows without doc_id come first, repeated rows are written each; an empty
    table gives an empty result; other columns are ignored. path is a vocabulary of the tokenizers library.
    """
    to = scratch_path(documents.sparkSession, "ids")
    write_ids(documents, to, path or vocabulary_path("word_bpe_49k.json"), end, block)
    return read_ids(documents.sparkSession, to)
