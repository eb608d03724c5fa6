from __future__ import annotations

import gzip
import hashlib

import pytest

from shiftledger.llm import warc
from shiftledger.llm.common import scratch_path
from tests.llm.odd import result

BIG = "<p>" + "grüße " * 9000


def pages(spark):
    data = [
        (1, "http://a.example/", BIG), (2, "http://a.example/2", BIG), (3, None, BIG), (None, "x\r\ny: z", BIG),
        (4, "http://b", "short"), (5, "http://b", "short"), (6, "http://b", None), (7, None, ""),
        (8, "u", "y" * 100), (8, "u", "y" * 100), (9, "v", "y" * 100), (10, "v", "y" * 99), (11, "v", "y" * 99),
        (None, "w", "z" * 200), (None, "w", "z" * 200),
    ]
    return [(*d, "s") for d in data], spark.createDataFrame([(*d, "s") for d in data], "page_id long, url string, html string, digest string")


def plain(data):
    first = {}
    for page_id, _, html, _ in data:
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html, _ in data:
        raw = (html or "").encode()
        refers = first.get(html) if len(raw) >= 100 and first.get(html) != page_id else None
        kind = "response" if refers is None else "revisit"
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [warc.SEGMENT, 50])
def test_archives_like_brute_force(spark, segment):
    data, frame = pages(spark)
    assert result(warc.archived(frame.where("page_id is null or page_id > 3" if segment == 50 else "true"), segment)) == plain(
        [d for d in data if segment != 50 or d[0] is None or d[0] > 3]
    )


def test_payloads_come_back(spark):
    data, frame = pages(spark)
    path = scratch_path(spark, "test")
    warc.write_pages(frame, path)
    found = warc.read_pages(spark, path).collect()
    assert all(r.complete for r in found) and len(found) == len(data)
    got = {r.page_id: bytes(r.payload) for r in found if r.record_type == "response" and r.page_id is not None}
    assert got == {i: (h or "").encode() for i, _, h, _ in data if i in got}
    assert {1, 4, 5, 6, 7, 8, 10, 11} == set(got)


def test_files_are_gzip_members_of_warc_records(spark, tmp_path):
    _, frame = pages(spark)
    warc.write_pages(frame.coalesce(1), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("part-*")
    text = gzip.decompress(file.read_bytes())
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC/1.1\r\nWARC-Type: revisit") == 4


def test_a_missing_segment_is_told(spark):
    payload = b"q" * 500
    digest = hashlib.sha256(payload).hexdigest()
    records = warc.page_records(1, "u", payload, digest, None, 100)
    assert len(records) > 4
    for lost in (0, 2, len(records) - 1):
        left = [r[:-1] for i, r in enumerate(reversed(records)) if len(records) - 1 - i != lost]
        path = scratch_path(spark, "lost")
        warc.write_bytes(spark.createDataFrame([(r,) for r in left], "value binary"), "value", path, "\x00", 2)
        found = warc.read_pages(spark, path).collect()
        assert not any(r.complete or r.payload_bytes for r in found) and len(found) == (lost > 0)


def test_chunks(spark):
    for payload in (b"", b"x", b"ab\r\n0\r\n\r\n" * 3000):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n")


def test_empty_table(spark):
    _, frame = pages(spark)
    assert warc.archived(frame.limit(0)).count() == 0
