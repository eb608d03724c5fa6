"""Benchmark decontamination by latent semantic retrieval.

1. Texts become word codes over the benchmark's vocabulary (0: any other word), stored once for the later passes.
2. Document frequencies over the whole corpus give IDF weights. Terms in at most 1 % of the documents or in 20, and
   the rarest words of every item, carry the passages; the rest only counts in the comparisons.
3. One pass over all passages sums G = A'A W, A being the TF-IDF rows of corpus and benchmark passages (both sides
   scaled to the same energy) and W a random matrix. Nyström's formula turns G into the leading singular directions.
   What travels is one (terms x rank) matrix from each of at most 2,000 tasks, summed by groups of 16 rows.
4. A window that has the words of half of an item's places makes the item a candidate. No match has fewer, so the
   search loses nothing, however hot an item is; the cosine of a match's projection is reported and decides nothing.
5. The longest common subsequence of item and window decides: nearly all words in order is a copy; fewer are a
   paraphrase if the item's answer (its column `answer`, else its last quarter) is there, too.

The benchmark is the query set. It is held in blocks of `block` items, so what is sent to tasks is bounded; each block
is one run over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, records, saved, text_bytes

RANK = 256
BLOCK = 1_000
SUM_TASKS = 2_000
SUM_ROWS = 16
COMMON, FEW = 0.01, 20
RAREST = 8
WINDOWS = 256
COPY = 0.8
PARAPHRASE = 0.5
_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
FOUND = "doc_id long, item_id long, start long, n_words long, common long, cosine double, kind string"


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of letters and digits, and all that is not ASCII."""
    return text.decode("utf-8", "replace").lower().encode().translate(_TABLE).split()


@dataclass
class Items:
    """A block of benchmark items as word codes."""

    ids: list
    codes: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]


def read_items(benchmark: DataFrame) -> Items:
    """Items without a word are left out: nothing can hold a copy of them."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer")).collect()
    vocabulary: dict[bytes, int] = {}
    code = lambda words: np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
    out = Items([], [], [], vocabulary)
    for item_id, text, answer in rows:
        codes = code(words_of((text or "").encode()))
        if len(codes):
            out.ids.append(item_id)
            out.codes.append(codes)
            last = codes[len(codes) - max(1, len(codes) // 4) :]
            out.answers.append(code(words_of(answer.encode())) if answer else last)
    return out


def coded(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, codes): word codes of every row as little-endian unsigned integers of two bytes, or of four."""
    schema = pa.schema([("doc_id", pa.int64()), ("codes", pa.binary())])
    kind = np.dtype("<u2" if len(vocabulary) < 65_535 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in records(batches):
            words = (words_of(t) for t in texts)
            codes = [np.fromiter(map(vocabulary.get, w, repeat(0)), kind, len(w)).tobytes() for w in words]
            yield batch_of(schema, ids, codes)

    return documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, codes binary")


def document_frequency(codes: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents. Tasks send sums, at most one row per term."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])
    kind = np.dtype("<u2" if size < 65_535 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 1, np.int64)
        for (lists,) in records(batches, 1024):
            held[0] += len(lists)
            values = [np.frombuffer(x, kind) for x in lists]
            owner = np.repeat(np.arange(len(values), dtype=np.int64), [len(v) for v in values])
            pairs = np.unique(owner * (size + 1) + np.concatenate([*values, np.zeros(0, kind)]))
            held[1:] += np.bincount(pairs % (size + 1), minlength=size + 1)[1:]
        terms = np.flatnonzero(held)
        yield batch_of(schema, terms, held[terms])

    sums = codes.select("codes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    total = int(out[0])
    out[0] = 0
    return out, total


def weights(items: Items, df: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """IDF of every code, and which codes carry passages."""
    idf = np.log((total + 1) / (df + 0.5)).clip(0.05)
    carries = df <= max(COMMON * total, FEW)
    for codes in items.codes:
        distinct = np.unique(codes)
        carries[distinct[np.argsort(-idf[distinct], kind="stable")[:RAREST]]] = True
    carries[0] = False
    idf[0] = idf[carries].mean()  # a word that no item has weighs in a passage's norm like one that carries
    return idf, carries


def _energy(codes: DataFrame, idf: np.ndarray, slot: np.ndarray, noise: np.ndarray, width: int = 64) -> tuple[np.ndarray, float]:
    """A'A W and the squared norm of A, A being the TF-IDF rows of all passages of `width` words."""
    kind = np.dtype("<u2" if len(idf) - 1 < 65_535 else "<u4")
    terms, rank = noise.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, norm = np.zeros((terms, rank), np.float64), 0.0
        for (lists,) in records(batches, 1024):
            base, passages, columns = 0, [], []
            for raw in lists:
                doc = np.frombuffer(raw, kind)
                at = np.flatnonzero(slot[doc] >= 0)
                passages.append(base + at // width)
                columns.append(doc[at])
                base += len(doc) // width + 1
            passage, code = np.concatenate(passages), np.concatenate(columns)
            if not len(code):
                continue
            cell, times = np.unique(passage * terms + slot[code], return_counts=True)
            row, column = cell // terms, cell % terms
            value = times * idf_of_slot[column]
            norm += float(value @ value)
            firsts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            sketch = np.add.reduceat(noise[column] * value[:, None], firsts, axis=0)
            of_row = np.repeat(np.arange(len(firsts)), np.diff(np.concatenate((firsts, [len(row)]))))
            order = np.argsort(column, kind="stable")
            column = column[order]
            groups = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
            spread = sketch[of_row[order]] * value[order][:, None]
            total[column[groups]] += np.add.reduceat(spread, groups, axis=0)
        for first in range(0, terms, SUM_ROWS):
            part = np.concatenate((total[first : first + SUM_ROWS].ravel(), [norm if not first else 0.0]))
            yield batch_of(schema, [first], [part.tobytes()])

    def summed(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        total = np.zeros(len(parts[0]) // 8)
        for raw in parts:
            total += np.frombuffer(raw)
        return pa.table({"first": table.column("first")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    schema = pa.schema([("first", pa.int64()), ("part", pa.binary())])
    idf_of_slot = np.zeros(terms)
    idf_of_slot[slot[slot >= 0]] = idf[slot >= 0]
    parts = codes.select("codes").coalesce(SUM_TASKS).mapInArrow(run, "first long, part binary")
    sums = parts.groupBy("first").applyInArrow(summed, "first long, part binary").toArrow()
    out, norm = np.zeros((terms, rank)), 0.0
    for first, raw in zip(sums.column("first").to_pylist(), sums.column("part").to_pylist(), strict=True):
        values = np.frombuffer(raw)
        out[first : first + SUM_ROWS] = values[:-1].reshape(-1, rank)
        norm += float(values[-1])
    return out, norm


def directions(codes: DataFrame, items: Items, idf: np.ndarray, slot: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Leading right singular directions (terms x rank) of the TF-IDF rows of corpus and benchmark passages."""
    terms = int(slot.max()) + 1
    rank = min(rank, terms)
    noise = np.random.default_rng(seed).standard_normal((terms, min(rank + 8, terms)))
    corpus, corpus_norm = _energy(codes, idf, slot, noise)
    rows = np.zeros((len(items.codes), terms))
    for i, item in enumerate(items.codes):
        held = item[slot[item] >= 0]
        np.add.at(rows[i], slot[held], idf[held])
    own = rows.T @ (rows @ noise)
    total = corpus / max(corpus_norm, 1e-12) + own / max(float((rows**2).sum()), 1e-12)
    inside = noise.T @ total
    shift = 1e-10 * max(np.trace(inside), 1e-12)
    lower = np.linalg.cholesky((inside + inside.T) / 2 + shift * np.eye(len(inside)))
    factor = np.linalg.solve(lower, total.T).T
    left, _, _ = np.linalg.svd(factor, full_matrices=False)
    return left[:, :rank].astype(np.float32)


def common_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine word operation per 64 item words and text word."""
    places: dict[int, int] = {}
    for i, code in enumerate(item.tolist()):
        places[code] = places.get(code, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for code in text.tolist():
        at = places.get(code)
        if at:
            met = row & at
            row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


def _windows(n: int, width: int) -> np.ndarray:
    """Starts of overlapping windows; the last ends with the text."""
    step = width // 4
    starts = np.arange(0, max(n - width, 0) + step, step, dtype=np.int64)
    return np.minimum(starts, max(n - width, 0))


def _search(codes: DataFrame, items: Items, idf: np.ndarray, slot: np.ndarray, basis: np.ndarray) -> DataFrame:
    kind = np.dtype("<u2" if len(idf) - 1 < 65_535 else "<u4")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())]
        + [("common", pa.int64()), ("cosine", pa.float64()), ("kind", pa.string())]
    )
    project = np.zeros((len(idf), basis.shape[1]), np.float32)
    project[slot >= 0] = basis[slot[slot >= 0]] * idf[slot >= 0][:, None].astype(np.float32)
    carried = np.where(slot >= 0, idf**2, 0)
    counted = carried.copy()
    counted[0] = idf[0] ** 2
    latent = np.array([project[c].sum(axis=0) for c in items.codes])
    held = np.array([float((np.unique(c, return_counts=True)[1] ** 2 * carried[np.unique(c)]).sum()) for c in items.codes])
    energy = np.maximum((latent**2).sum(axis=1), 1e-9)
    lengths = np.array([len(c) for c in items.codes])
    widths = np.array([max(32, 1 << int(np.ceil(np.log2(n * 4 / 3)))) for n in lengths])
    # places of each word in each item, by word
    size = len(items.codes)
    cells, times = np.unique(np.concatenate(items.codes) * size + np.repeat(np.arange(size), lengths), return_counts=True)
    owner, times = cells % size, times.astype(np.float32)
    begin = np.searchsorted(cells // size, np.arange(len(idf) + 1))

    def postings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the given distinct words, (row in codes, cell) of all items that have them."""
        many = begin[codes + 1] - begin[codes]
        row = np.repeat(np.arange(len(codes)), many)
        return row, np.arange(len(row)) + np.repeat(begin[codes] - (np.cumsum(many) - many), many)

    def cosine(doc: np.ndarray, start: int, item: int) -> float:
        part = doc[start : start + int(widths[item])]
        share = float(project[part].sum(axis=0) @ latent[item]) / float(energy[item])
        return share * float(np.sqrt(held[item])) / max(float(np.sqrt(counted[part].sum())), 1e-9)

    def verified(doc: np.ndarray, start: int, item: int) -> tuple | None:
        codes, part = items.codes[item], doc[start : start + int(widths[item])]
        common = common_length(codes, part)
        if common >= COPY * len(codes):
            return start, common, "copy"
        answer = items.answers[item]
        if common >= PARAPHRASE * len(codes) and common_length(answer, part) >= PARAPHRASE * len(answer):
            return start, common, "paraphrase"
        return None

    def candidates(doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item) of all windows that hold the words of half of the item's places, as any match does."""
        words = np.unique(doc)
        words = words[words > 0]
        row, cell = postings(words)
        able = np.bincount(owner[cell], times[cell], size) >= PARAPHRASE * lengths
        for width in np.unique(widths[able]):
            mine = np.flatnonzero(able & (widths == width))
            column = np.full(size, -1)
            column[mine] = np.arange(len(mine))
            kept = column[owner[cell]] >= 0
            used = np.unique(row[kept])
            places = np.zeros((len(used), len(mine)), np.float32)
            places[np.searchsorted(used, row[kept]), column[owner[cell[kept]]]] = times[cell[kept]]
            at = np.flatnonzero(np.isin(doc, words[used]))
            word = np.searchsorted(words[used], doc[at])
            starts = _windows(len(doc), int(width))
            for chunk in range(0, len(starts), WINDOWS):
                some = starts[chunk : chunk + WINDOWS]
                first, last = np.searchsorted(at, some), np.searchsorted(at, some + width)
                many = last - first
                window = np.repeat(np.arange(len(some)), many)
                there = np.arange(len(window)) + np.repeat(first - (np.cumsum(many) - many), many)
                # only the chunk's own words, so that the table is bounded by the chunk
                own, mapped = np.unique(word[there], return_inverse=True)
                holds = np.zeros((len(some), len(own)), np.float32)
                holds[window, mapped] = 1
                for w, i in zip(*np.nonzero(holds @ places[own] >= PARAPHRASE * lengths[mine]), strict=True):
                    yield int(some[w]), int(mine[i])

    def matches(doc: np.ndarray) -> dict[int, tuple]:
        """Best match of each item: the most common words, then the first window."""
        best: dict[int, tuple] = {}
        for start, item in candidates(doc):
            found = verified(doc, start, item)
            if found and (item not in best or found[1] > best[item][1]):
                best[item] = found
        return {item: (start, common, cosine(doc, start, item), how) for item, (start, common, how) in best.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in records(batches):
            rows = []
            for doc_id, raw in zip(ids, lists, strict=True):
                for item, (start, common, value, how) in matches(np.frombuffer(raw, kind).astype(np.int64)).items():
                    rows.append((doc_id, items.ids[item], start, len(items.codes[item]), common, value, how))
            if rows:
                yield batch_of(schema, *zip(*rows, strict=True))

    return codes.mapInArrow(run, FOUND)


def contaminated(documents: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, start, n_words, common, cosine, kind): items that rows of documents hold.

    start is the word at which the best window begins, n_words the item's words, common its longest common subsequence
    with the window, kind copy or paraphrase. Null and empty texts hold nothing, items without a word are nowhere;
    rows without doc_id report a null doc_id, repeated rows are reported each; empty tables give an empty result; other
    columns are ignored (a column answer of the benchmark is used).
    """
    spark = documents.sparkSession
    blocks = -(-benchmark.count() // block)
    part = F.pmod(F.xxhash64(F.col("item_id"), F.col("text")), F.lit(max(blocks, 1)))
    found = spark.createDataFrame([], FOUND)
    for i in range(blocks):
        items = read_items(benchmark.where(part == i))
        if not items.ids:
            continue
        codes = saved(coded(documents, items.vocabulary), "codes")
        df, total = document_frequency(codes, len(items.vocabulary))
        idf, carries = weights(items, df, total)
        slot = np.where(carries, np.cumsum(carries) - 1, -1)
        basis = directions(codes, items, idf, slot, rank)
        found = found.union(_search(codes, items, idf, slot, basis))
    return found


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no item, with all their columns. Rows without doc_id stay: no decision names them."""
    gone = saved(contaminated(documents, benchmark), "contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return documents.join(gone, documents["doc_id"].cast("long") == gone["__id"], "left_anti")
