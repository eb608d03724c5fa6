"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits. If two fingerprints differ in at most three bits, one of the halves
differs in at most one, so it lies in the Hamming ball of radius one around the other's half. Each fingerprint is
filed under its two halves; each looks up the halves of the ball; what meets is compared in full. Of two halves that
differ in one bit, exactly one has a zero there, so only zero bits are flipped: half the ball finds every pair.

Equal fingerprints are folded first, so copies never meet each other, and links are between different fingerprints.
Keys of 32 bits keep buckets small: a bucket has about n / 2^32 fingerprints. A hot bucket is a join key with many
rows on both sides, which adaptive execution splits; only true links leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, records, saved, text_bytes
from shiftledger.llm.graph import components

SEED = 42
DISTANCE = 3
_CHUNK = 1 << 16
_OFFSETS = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(data: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over the word shingles of UTF-8 bytes; zero without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - width + 1, 1)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, last, _CHUNK):
        pairs = zip(starts[at : min(at + _CHUNK, last)].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        values = np.array([hashed(joined[a:b], SEED) for a, b in pairs], np.uint64)
        lanes = values.astype("<u8").view(np.uint8).reshape(-1, 8) + _OFFSETS
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (counts.ravel() * 2 > last).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long. Null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in records(batches, 2048):
            values = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield batch_of(schema, ids, values)

    rows = documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints fp at most `distance` bits apart (three at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with balls of radius one find up to three bits")
    halves = F.inline(
        F.array(
            F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("half")),
            F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
        )
    )
    filed = distinct.select("fp", halves)
    key = lambda half: (F.col("part").cast("long") * F.lit(1 << 32)).bitwiseOR(half).alias("key")
    flips = F.array(*(F.lit(m) for m in [0, *(1 << i for i in range(32))]))
    ball = (
        filed.withColumn("flip", F.explode(flips))
        .where(F.col("half").bitwiseAND(F.col("flip")) == 0)
        .select(F.col("fp").alias("p"), key(F.col("half").bitwiseOR(F.col("flip"))), (F.col("flip") == 0).alias("same"))
    )
    table = filed.select(F.col("fp").alias("q"), key(F.col("half")))
    near = (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= distance) & (~F.col("same") | (F.col("p") < F.col("q")))
    # Spark sizes a row's 34 places in balls as one, and a table it thinks small would be sent to the driver
    met = ball.hint("merge").join(table, "key").where(near)
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_duplicates(documents: DataFrame, width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of documents.

    component_id is the smallest doc_id reachable over links. Null and empty texts have fingerprint zero and link like
    any other. Rows with a null doc_id take part and get the id of their class (null if no row of it has one);
    repeated rows come back repeated; an empty table gives an empty result; other columns are ignored.

    All tables here grow with the documents, so none is broadcast, whatever size their compressed files suggest.
    """
    rows = saved(fingerprints(documents, width), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    classes = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    classes = saved(classes, "classes")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of its near-duplicate group, with all their columns.

    Rows that share doc_id and text are one document and come once; a doc_id with several texts stays with all of them
    if one of them stays. Rows without doc_id cannot be named by a decision and stay. An empty table stays empty.
    """
    return keep_least(documents, near_duplicates(documents))


def keep_least(documents: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of documents that the groups (doc_id, component_id) of its rows leave, see one_of_each_group()."""
    named = named.where("doc_id is not null")
    decided = named.groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("__stays"), F.count("*").alias("__rows")
    )
    decided = saved(decided, "decided")
    # decisions grow with the documents, so they are never broadcast
    gone = decided.where("not __stays").select("__id").hint("merge")
    kept = documents.join(gone, documents["doc_id"].cast("long") == gone["__id"], "left_anti")
    repeated = decided.where("__stays and __rows > 1").select("__id").hint("merge")
    if repeated.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == repeated["__id"]
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)
