"""WARC archives of pages: revisits for equal payloads, segmented records, chunked transfer framing.

Writing: a page is a response record with an HTTP block whose body is sent in chunks. Blocks over `segment` bytes are
cut: the first record says WARC-Segment-Number 1, continuation records name it in WARC-Segment-Origin-ID, the last one
tells WARC-Segment-Total-Length. Of equal payloads of at least `least` bytes one is a response, the others are revisit
records without payload. Every record is a gzip member of its own, so files are ordinary .warc.gz files. (A member ends
with the high byte of its length, zero as long as records stay under 16 MB: that byte is the writer's separator.)

Reading: files are parsed where they lie; segments may be in any order and any file. Continuations are grouped by
origin, put in order by number and joined to their first record; the total length tells whether anything is missing.
A group is as large as one payload. Payloads are not shuffled for the search of equal ones, only their digests.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm.common import batch_of, read_bytes, records, saved, scratch_path, text_bytes, write_bytes

SEGMENT = 16 * 1024
CHUNK = 4096
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 5_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than it says")
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record as a gzip member. Control characters in a field are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    for name, value in fields.items():
        if value is not None:
            lines.append(f"{name}: {_CONTROL.sub(lambda m: '%%%02X' % ord(m[0]), value)}")  # noqa: UP031
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def identifier(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str) -> int | None:
    number = identifier.split(":")[2]
    return int(number) if number else None


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int) -> list[bytes]:
    """The records of a page; first is the page that a revisit refers to."""
    own = identifier(page_id, digest)
    fields = {"WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}"}
    if first is not None:
        head = {"WARC-Refers-To": identifier(first, digest), "WARC-Profile": _REVISIT}
        return [record("revisit", fields | head | {"Content-Type": "application/http;msgtype=response"}, _HTTP)]
    fields["Content-Type"] = "application/http;msgtype=response"
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        return [record("response", fields, block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record("response", fields | {"WARC-Segment-Number": "1"}, parts[0])]
    for number, part in enumerate(parts[1:], 2):
        more = {"WARC-Record-ID": f"{own[:-1]}:{number}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": own}
        more["WARC-Segment-Number"] = str(number)
        if number == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record("continuation", more, part))
    return out


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, unpacked, without copying what is left for each."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the file ends inside a record")
            piece = view[at : at + 65536]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields in lower case, and the block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def write_pages(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST) -> None:
    """Write one response or revisit for each row of pages (page_id, url, html) below path.

    Null html is an empty payload, a null url has no WARC-Target-URI. Of equal payloads of at least `least` bytes the
    rows with the smallest page_id are responses (repeated rows of it, too); rows without page_id revisit it, or are
    responses if no row of the group has one. Other columns are ignored.
    """
    if not 0 < segment <= 8 << 20:
        raise ValueError("segments have 1 byte to 8 MiB")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.length("payload") >= least).select("page_id", "digest")
    group = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = long.distinct().join(group, "digest").where("first is not null and not page_id <=> first")
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    # digests are repeated with the page, so no key is hot
    joined = rows.join(again, rows.page_id.eqNullSafe(again.p) & (rows.digest == again.d), "left")
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in records(batches):
            out = [r[:-1] for row in zip(*columns, strict=True) for r in page_records(*row, segment)]
            yield batch_of(schema, out)

    packed = joined.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "value binary")
    write_bytes(packed, "value", path, "\x00", RECORDS_PER_FILE)


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, complete) of archives below path.

    Bytes and digest are those of the payload as read; a revisit has those of the response it refers to. complete
    tells whether all segments were there and the digest is the one in the header; what is not complete has null bytes
    and digest. payload is null for revisits, and throughout unless `payloads`.
    """
    kinds = (
        "id string, url string, kind string, origin string, refers string, said string, number int, total long,"
        " size long, digest string, payload binary, part binary"
    )
    schema = pa.schema(
        [(n, pa.string()) for n in ("id", "url", "kind", "origin", "refers", "said")]
        + [("number", pa.int32()), ("total", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]
        + [("payload", pa.binary()), ("part", pa.binary())]
    )
    number = lambda fields, name: int(fields[name]) if name in fields else None

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, segment = fields["warc-type"], number(fields, "warc-segment-number")
        payload = payload_of(block) if kind == "response" and segment is None else None
        return (
            fields["warc-record-id"], fields.get("warc-target-uri"), kind, fields.get("warc-segment-origin-id"),
            fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), segment,
            number(fields, "warc-segment-total-length"), None if payload is None else len(payload),
            None if payload is None else hashlib.sha256(payload).hexdigest(), payload if payloads else None,
            None if segment is None else block,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, contents in records(batches, 1):
            rows = []
            for member in members(contents[0]):
                rows.append(row(*parsed(member)))
                if len(rows) == 512:
                    yield batch_of(schema, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield batch_of(schema, *zip(*rows, strict=True))

    found = saved(read_bytes(spark, path).mapInArrow(run, kinds), "records")
    firsts = found.where("kind = 'response'")
    head = ["id", "url", "said", "size", "digest", "payload"]
    responses = firsts.where("number is null").select(*head).union(_reassembled(firsts, found, payloads).select(*head))
    responses = responses.withColumn("complete", F.coalesce(F.col("digest") == F.col("said"), F.lit(False)))
    target = responses.groupBy(F.col("id").alias("refers")).agg(
        F.max("size").alias("size"), F.max("digest").alias("digest"), F.max("complete").alias("complete")
    )
    revisits = found.where("kind = 'revisit'").select("id", "url", "said", "refers").join(target, "refers", "left")
    revisits = revisits.withColumn("complete", F.coalesce("complete", F.lit(False)) & (F.col("digest") == F.col("said")))
    both = responses.withColumn("refers", F.lit(None).cast("string")).unionByName(
        revisits.withColumn("payload", F.lit(None).cast("binary"))
    )
    page = lambda c: F.split(c, ":")[2]
    as_id = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return both.select(
        as_id("id").alias("page_id"),
        "url",
        F.when(F.col("refers").isNull(), "response").otherwise("revisit").alias("record_type"),
        as_id("refers").alias("refers_to"),
        F.when(F.col("complete"), F.col("size")).alias("payload_bytes"),
        F.when(F.col("complete"), F.col("digest")).alias("payload_digest"),
        "payload",
        F.coalesce("complete", F.lit(False)).alias("complete"),
    )


def _reassembled(firsts: DataFrame, found: DataFrame, payloads: bool) -> DataFrame:
    """First records with their continuations: size and digest are null where the total length does not fit."""
    more = found.where("kind = 'continuation'").groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("number", "part"))).alias("parts"), F.max("total").alias("all")
    )
    joined = firsts.where("number = 1").select("id", "url", "said", "part").join(more, F.col("id") == F.col("origin"), "left")
    kinds = "id string, url string, said string, size long, digest string, payload binary"
    schema = pa.schema(
        [("id", pa.string()), ("url", pa.string()), ("said", pa.string()), ("size", pa.int64()), ("digest", pa.string())]
        + [("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in records(batches, 16):
            out = []
            for id_, url, said, first, parts, total in zip(*columns, strict=True):
                block = first + b"".join(p["part"] for p in parts or [])
                whole = total is not None and len(block) == total
                payload = payload_of(block) if whole else None
                digest = hashlib.sha256(payload).hexdigest() if whole else None
                out.append((id_, url, said, len(payload) if whole else None, digest, payload if payloads else None))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return joined.select("id", "url", "said", "part", "parts", "all").mapInArrow(run, kinds)


def archived(pages: DataFrame, segment: int = SEGMENT, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages, read from archives written for them."""
    path = scratch_path(pages.sparkSession, "warc")
    write_pages(pages, path, segment, least)
    read = read_pages(pages.sparkSession, path, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
