import base64
import hashlib
from collections import Counter

import pytest
from framelake.llm import warc
from framelake.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, id string, payload string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def check(spark, rows, **options):
    folder = scratch_path(spark, "warc-test")
    files = warc.write_warc(frame(spark, rows), folder, **options)
    back = warc.read_warc(spark, folder, files).collect()
    own = {}
    for i, _, t in rows:
        ids = own.setdefault((t or "").encode(), [])
        if i is not None:
            ids.append(i)
    copies = Counter((t or "").encode() for _, _, t in rows)
    want = Counter()
    for i, url, t in rows:
        data = (t or "").encode()
        ref = max(own[data], default=None) if copies[data] > 1 and len(data) >= options.get("min_revisit_bytes", 0) else None
        revisit = ref is not None and ref != i
        want[str(i) if i is not None else None, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", str(ref) if revisit else None, None if revisit else data] += 1
    assert Counter((r["row_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in back) == want
    return back


ROWS = [
    (1, "http://a", "hello"), (2, "http://b\r\nX: y", "hello"), (3, None, None), (4, "", ""), (None, "u", "hello"), (None, "u", "alone"), (None, "u", "nulls"), (None, "u", "nulls"),
    (5, "long", "é" * 100_000), (5, "long", "é" * 100_000), (6, "l", "x" * 16_001), (7, "crlf", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (8, "one", "y" * 64_000),
]


def test_round_trip(spark):
    check(spark, ROWS)


def test_small_segments_chunks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    check(spark, ROWS, segment_bytes=100, chunk_bytes=7, broadcast_groups=0)


def test_small_payloads_are_no_revisits(spark):
    check(spark, ROWS, min_revisit_bytes=6)


def test_empty_table(spark):
    assert check(spark, []) == []


def test_reassembly_checks():
    assert warc.reassemble([(2, 5, b"lo"), (1, None, b"hel")]) == b"hello"
    for parts in ([(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(ValueError):
            warc.reassemble(parts)


def test_dechunk():
    data = bytes(range(256)) * 9
    assert warc.dechunk(warc.chunked(data, 100)) == data and warc.dechunk(warc.chunked(b"", 5)) == b""
    assert warc.dechunk(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunk(b"2\r\nabc\r\n0\r\n\r\n")


def test_plain_archives_are_read():
    a, b = (warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<{n}>")], b"HTTP/1.1 200 OK\r\n\r\nbody" + n.encode()) for n in "xy")
    assert [warc.parse(r, True)[-1] for r in warc.members(memoryview(a + b))] == [b"bodyx", b"bodyy"]
