"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A window is `window` consecutive words of one text; a word goes if a window that covers it also starts elsewhere.

1. Every distinct text lists its anchors: the least 8-word hash inside each window. Equal windows have equal anchors,
   so only windows whose anchor occurs twice in the corpus can repeat. The anchors are some 7 % of the words, and no
   other suffix is ever shuffled.
2. The suffixes that start such windows are written as paths of block fingerprints: words 0-8, 8-16, 16-24 and the
   rest of the window. Variable-length prefixes of the path split them into groups: a prefix with more than `group`
   suffixes is made one block longer, until it spans the window, where the group is a single deep node.
3. A group's suffix tree is its sorted suffixes with the common prefix of neighbours. Internal nodes as deep as the
   window are runs of equal paths of two or more: the repeats. Sorting spills to disk, and a run is read as a stream,
   so memory does not depend on the size of a group.

Texts with exact copies need no tree of their own: all their windows repeat. One row of each distinct text takes part,
whatever the number of copies. Fingerprints of a path have 160 bits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, drop_saved, records, release, saved, text_bytes

WINDOW = 35
BLOCK = 8
GROUP = 200_000
PATH = ["b1", "b2", "b3", "b4"]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` consecutive words."""
    count = len(hashes) - size + 1
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = total * _MULTIPLIER + hashes[i : i + count]
    total ^= total >> np.uint64(32)
    total *= _MIX
    return total ^ (total >> np.uint64(29))


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """Least of every `span` consecutive values."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = span - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Distinct anchors of a text; one that the text holds at several places is listed twice."""
    grams = blocks(hashes, BLOCK)
    least = sliding_least(grams, window - BLOCK + 1)
    found = np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))])
    grams.sort()
    again = grams[1:][grams[1:] == grams[:-1]]
    return np.concatenate((found, found[np.isin(found, again)])) if len(again) else found


def paths(hashes: np.ndarray, window: int, hit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the windows whose anchor is among `hit`, and the four block fingerprints of each."""
    grams = blocks(hashes, BLOCK)
    least = sliding_least(grams, window - BLOCK + 1)
    starts = np.flatnonzero(np.isin(least, hit))
    rest = blocks(hashes, window - 3 * BLOCK)
    low = lambda values: values.astype(np.uint32).view(np.int32)
    return starts, [
        grams[starts].view(np.int64),
        low(grams[starts + BLOCK]),
        low(grams[starts + 2 * BLOCK]),
        low(rest[starts + 3 * BLOCK]),
    ]


def removed_words(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words covered by a window that starts at one of `starts`."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def edited(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words of the mask: runs of kept words as they stood, joined by a space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return b""
    breaks = np.flatnonzero(np.diff(kept) > 1)
    firsts, lasts = kept[np.concatenate(([0], breaks + 1))], kept[np.concatenate((breaks, [len(kept) - 1]))]
    return b" ".join(text[spans[a][0] : spans[b][1]] for a, b in zip(firsts, lasts, strict=True))


def _rows(documents: DataFrame) -> DataFrame:
    """rid stands for doc_id and is never null."""
    doc_id = F.col("doc_id").cast("long")
    return documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(2**63))).alias("rid"), text_bytes().alias("text"))


def _profiles(rows: DataFrame, window: int) -> DataFrame:
    """Per row: the text's digest, its words, the digest of the joined words, and its anchors."""
    kinds = "doc_id long, rid long, key binary, n_words long, whole_sha string, anchors array<long>"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("rid", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64())]
        + [("whole_sha", pa.string()), ("anchors", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rids, texts in records(batches):
            keys, counts, shas, found = [], [], [], []
            for text in texts:
                words = text.split()
                keys.append(hashlib.sha256(text).digest())
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(anchors(word_hashes(words), window).view(np.int64) if len(words) >= window else [])
            yield batch_of(schema, ids, rids, keys, counts, shas, found)

    return rows.mapInArrow(run, kinds)


def _suffixes(held: DataFrame, window: int) -> DataFrame:
    """(hid, start, b1..b4) of every suffix whose anchor is a hit of its text."""
    kinds = "hid long, start int, b1 long, b2 int, b3 int, b4 int"
    schema = pa.schema([("hid", pa.int64()), ("start", pa.int32()), ("b1", pa.int64())] + [(b, pa.int32()) for b in PATH[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, hits in records(batches):
            parts = []
            for hid, text, hit in zip(ids, texts, hits, strict=True):
                starts, path = paths(word_hashes(text.split()), window, np.array(hit, np.int64).view(np.uint64))
                parts.append([np.full(len(starts), hid), starts.astype(np.int32), *path])
            yield batch_of(schema, *map(np.concatenate, zip(*parts, strict=True)))

    return held.select("hid", "text", "hits").mapInArrow(run, kinds)


def _tree(suffixes: DataFrame, prefix: list[str]) -> DataFrame:
    """(hid, start) of the suffixes below an internal node that is as deep as the window, one group per prefix."""
    schema = pa.schema([("hid", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last suffix, whose right neighbour is in the next batch
        before = False  # whether it shares its whole path with the one on its left
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate((h, c)) for h, c in zip(held, columns, strict=True)]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns[2:]])
            deep = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            yield batch_of(schema, columns[0][:-1][deep[:-1]], columns[1][:-1][deep[:-1]])
            held, before = [c[-1:] for c in columns], bool(same[-1]) if len(same) else before
        if held is not None and before:
            yield batch_of(schema, held[0], held[1])

    return suffixes.repartition(*prefix).sortWithinPartitions(*PATH).mapInArrow(run, "hid long, start int")


def _repeated(suffixes: DataFrame, group: int) -> DataFrame:
    """(hid, start) of all windows that start at two places or more."""
    found, rest = None, suffixes
    for depth in range(1, len(PATH) + 1):
        prefix = PATH[:depth]
        large = saved(rest.groupBy(*prefix).count().where(F.col("count") > group).select(*prefix), "prefixes")
        if large.isEmpty():
            part, rest = _tree(rest, prefix), None
        else:
            part = _tree(rest.join(large, prefix, "left_anti").select("hid", "start", *PATH), prefix)
            rest = rest.join(large, prefix, "left_semi").select("hid", "start", *PATH)
        found = part if found is None else found.union(part)
        if rest is None:
            return found
    return found.union(rest.select("hid", "start"))  # prefixes of a whole window: each is one deep node


class Repeats:
    """The repeated windows of a table.

    rows: doc_id, key (digest of the text), n_words, whole_sha per row. changed: key, starts, n_removed, kept_sha, text
    per distinct text of which a part goes. copies: keys of texts of at least a window that several rows have; all
    their words go.
    """

    def __init__(self, documents: DataFrame, window: int = WINDOW, group: int = GROUP):
        if window <= 3 * BLOCK:
            raise ValueError(f"a window has more than {3 * BLOCK} words")
        spark = documents.sparkSession
        self.window = window
        rows = _rows(documents)
        profiles = saved(_profiles(rows, window), "profiles")
        texts = profiles.groupBy("key").agg(
            F.count("*").alias("copies"), F.min("rid").alias("rid"), F.first("n_words").alias("n_words"),
            F.first("anchors").alias("anchors"),
        )
        texts = saved(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
        self.rows = saved(profiles.select("doc_id", "key", "n_words", "whole_sha"), "rows")
        drop_saved(profiles)
        self.copies = texts.where(f"copies > 1 and n_words >= {window}").select("key")
        listed = texts.where("size(anchors) > 0").select("tid", F.explode("anchors").alias("anchor"))
        twice = listed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        # Spark sizes a text's anchors as one, and their lists by compressed files, so neither may be broadcast
        hits = saved(listed.join(twice.hint("merge"), "anchor").groupBy("tid").agg(F.collect_set("anchor").alias("hits")), "hits")
        del profiles, listed, twice
        release(spark)
        named = hits.hint("merge").join(texts.select("tid", "key", "rid"), "tid").select("key", "rid", "hits")
        met = rows.select("rid", "text").join(named, "rid").where(F.unhex(F.sha2("text", 256)) == F.col("key"))
        self._held = saved(met.select("key", "text", "hits", F.monotonically_increasing_id().alias("hid")), "held")
        drop_saved(hits)
        del hits, named, met
        release(spark)
        # made anew for the prefix counts and for the trees: that is cheaper than keeping them on disk
        starts = _repeated(_suffixes(self._held, window), group).groupBy("hid").agg(F.collect_list("start").alias("starts"))
        self._starts = saved(starts, "starts")
        del starts
        release(spark)

    def changed(self) -> DataFrame:
        window = self.window
        kinds = "key binary, starts array<int>, n_removed long, kept_sha string, text string"
        schema = pa.schema(
            [("key", pa.binary()), ("starts", pa.list_(pa.int32())), ("n_removed", pa.int64())]
            + [("kept_sha", pa.string()), ("text", pa.string())]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, texts, lists in records(batches):
                removed, shas, left = [], [], []
                for text, starts in zip(texts, lists, strict=True):
                    words = text.split()
                    gone = removed_words(len(words), np.array(starts, np.int64), window)
                    removed.append(int(gone.sum()))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    shas.append(hashlib.sha256(kept).hexdigest())
                    left.append(edited(text, gone).decode())
                yield batch_of(schema, keys, [sorted(x) for x in lists], removed, shas, left)

        partly = self._held.join(self.copies, "key", "left_anti").select("hid", "key", "text")
        return partly.join(self._starts, "hid").select("key", "text", "starts").mapInArrow(run, kinds)


def removals(documents: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of documents.

    Null and empty texts have no words; texts shorter than a window lose none. Rows with a null doc_id take part.
    Repeated rows are copies of each other, so windows in them repeat. An empty table gives an empty result. Other
    columns are ignored.
    """
    found = Repeats(documents, window, group)
    changed = found.changed().select("key", "n_removed", "kept_sha")
    whole = found.copies.select("key", F.lit(-1).cast("long").alias("n_removed"), F.lit(EMPTY_SHA).alias("kept_sha"))
    decided = found.rows.join(changed.union(whole), "key", "left")
    return decided.select(
        "doc_id",
        "n_words",
        F.when(F.col("n_removed") == -1, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce("kept_sha", "whole_sha").alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The same rows and columns, texts without their repeated passages (n_chars follows, if there is one).

    Texts that lose nothing stay as they are, null stays null.
    """
    found = Repeats(documents, window, group)
    changed = found.changed().select(F.col("key").alias("__key"), F.col("text").alias("__text"))
    cut = changed.union(found.copies.select(F.col("key").alias("__key"), F.lit("").alias("__text")))
    own = {name: documents[name] for name in documents.columns}
    marked = documents.join(cut, F.unhex(F.sha2(F.coalesce(own["text"].cast("string"), F.lit("")), 256)) == cut["__key"], "left")
    out = own | {"text": F.coalesce(cut["__text"], own["text"]).alias("text")}
    if "n_chars" in own:
        length = F.length(cut["__text"]).cast(documents.schema["n_chars"].dataType)
        out["n_chars"] = F.when(cut["__text"].isNull(), own["n_chars"]).otherwise(length).alias("n_chars")
    return marked.select(*(out[name] for name in documents.columns))
