"""WARC archives: a writer with revisit and continuation records, and a reassembling reader.

Writing: equal payloads (by SHA-1) form a group, whose row with the largest id is a
response and whose others are revisits of it. HTTP responses of more than
``segment_bytes`` are split into a first segment and continuation records; payloads
of more than ``chunk_bytes`` are framed as chunked transfer. Each record is a gzip
member. A task writes its files under names of its own attempt and reports them, and
only reported files are read, so lost or repeated tasks leave no half or double data.

Reading: archives are parsed file by file. Unsegmented records are finished at once;
segments are grouped by the identifier of their origin, ordered by segment number,
checked to be without gaps and against the total length, joined, and their chunked
framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import BATCH_ROWS, Table, bounded_batches, lean, scratch_path

#: A new file begins beyond so many compressed bytes; a reading task holds one file.
FILE_BYTES = 8_000_000
SEGMENT_BYTES = 64_000
CHUNK_BYTES = 16_000
#: Up to so many groups of equal payloads are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Header fields of the format; the two Source-Row fields are extensions that carry the row's id.
RECORD = "record_id string, type string, target_uri string, row_id string, refers_to string, segment int, total long, origin string, block binary, payload_bytes long, payload_digest string, payload binary"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def chunked(data: bytes, size: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunk(data: bytes) -> bytes:
    """Decodes chunked transfer framing: chunk extensions and trailers are allowed, a missing end isn't."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the payload of an HTTP response, its transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, dechunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def split_segments(block: bytes, size: int) -> list[bytes]:
    return [block[i : i + size] for i in range(0, len(block), size)] or [b""]


def uri(url: str | None) -> str:
    """A header value on one line."""
    return " ".join((url or "").split()) or "about:blank"


def records(row_id: str | None, url: str | None, payload: bytes, revisit_of: tuple[str, str] | None, record_id: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one row: a revisit, a response, or a response and its continuations."""
    framed = len(payload) > chunk_bytes and not revisit_of
    length = "Transfer-Encoding: chunked" if framed else f"Content-Length: {len(payload)}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{length}\r\n\r\n".encode()
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url)), ("WARC-Source-Row", row_id)]
    digest = [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit_of:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", uri(revisit_of[1])), ("WARC-Refers-To-Source-Row", revisit_of[0])]
        return [record_bytes([("WARC-Type", "revisit"), *common, *more, *digest], head)]
    block = head + (chunked(payload, chunk_bytes) if framed else payload)
    parts = split_segments(block, segment_bytes)
    if len(parts) == 1:
        return [record_bytes([("WARC-Type", "response"), *common, *digest], block)]
    out = [record_bytes([("WARC-Type", "response"), *common, *digest, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{n}').urn}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url))]
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(record_bytes([("WARC-Type", "continuation"), *own, ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n)), *total], part))
    return out


class Archive:
    """Files of one task, each below FILE_BYTES but for its last record."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.uri, self.name = folder, name
        self.done: list[tuple[str, int, int]] = []
        self.out, self.n, self.size = None, 0, 0

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.file = f"{self.name}-{len(self.done)}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.file}", compression=None)
            self.n = self.size = 0
        packer = zlib.compressobj(1, wbits=31)
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.n, self.size))
            self.out = None


def _writer(folder: str, segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive, n = Archive(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}"), 0
        for b in batches:
            for row_id, url, payload, ref, ref_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{archive.name}#{n}").urn
                for record in records(row_id, url, payload, (ref, ref_url) if ref is not None else None, record_id, segment_bytes, chunk_bytes):
                    archive.write(record)
                n += 1
        archive.close()
        if archive.done:
            files, counts, sizes = zip(*archive.done, strict=True)
            yield pa.record_batch([pa.array(files), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return run


def write_warc(
    df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", text_column: str = "html",
    min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Writes a record (and its continuations) per row; returns the files: ``file, records, bytes``.

    Null texts are empty payloads; null urls become about:blank. Of rows with
    equal payloads of at least ``min_revisit_bytes`` bytes, those with the
    largest id are responses, all others revisits of it; ids may repeat or be
    null (null is no largest id, unless a group has no other). An empty table
    writes no file. Other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    large = F.length("payload") >= min_revisit_bytes
    groups = rows.filter(large).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("ref"), F.max(F.struct("id", "url")).getField("url").alias("ref_url"))
    groups = Table(groups.filter("n > 1 and ref is not null").drop("n"), "equal-payloads").df
    few = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    joined = rows.join(F.broadcast(groups) if few else groups, "digest", "left")
    revisit = large & F.col("ref").isNotNull() & ~F.coalesce(F.col("id") == F.col("ref"), F.lit(False))
    out = joined.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(revisit, F.col("ref")).cast("string").alias("ref"), F.when(revisit, F.col("ref_url")).alias("ref_url"))
    pyarrow_fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    pyarrow_fs.create_dir(path, recursive=True)
    return Table(out.mapInArrow(lean(_writer(folder, segment_bytes, chunk_bytes)), "file string, records long, bytes long"), "warc-files").df


def members(content: memoryview) -> Iterator[bytes]:
    """Records of an archive's bytes: gzip members, or plain records one after another."""
    at = 0
    if bytes(content[:2]) != b"\x1f\x8b":
        data = bytes(content)
        while (at := data.find(b"WARC/", at)) >= 0:
            end = data.index(b"\r\n\r\n", at) + 4
            size = next(int(x.partition(b":")[2]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
            yield data[at : end + size]
            at = end + size
        return
    while at < len(content):
        unpack, parts = zlib.decompressobj(wbits=31), []
        while not unpack.eof:
            part = content[at : at + 65536]
            if not len(part):
                raise ValueError("a gzip member is cut short")
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(record: bytes, with_payload: bool) -> tuple:
    """A row of RECORD: finished if the record is whole, else with the segment's block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is shorter than its length")
    own, origin = (fields.get(k, "").strip("<>") for k in ("warc-record-id", "warc-segment-origin-id"))
    kind, segment, total = fields["warc-type"], fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    base = (own, kind, fields.get("warc-target-uri"), fields.get("warc-source-row"), fields.get("warc-refers-to-source-row"))
    if segment:
        return (*base, int(segment), int(total) if total else None, origin or own, block, None, digest, None)
    if kind == "revisit":
        return (*base, None, None, own, None, int(http_payload(block)[0]["content-length"]), digest, None)
    payload = http_payload(block)[1]
    return (*base, None, None, own, None, len(payload), base32_sha1(payload), payload if with_payload else None)


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for member in members(memoryview(content.as_buffer())):
                    rows.append(parse(member, with_payload))
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return run


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in RECORD.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record from (number, total length, block) in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != [*range(1, len(parts) + 1)]:
        raise ValueError("a segment is missing or doubled")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError("the segments' lengths don't add up to the total length")
    return block


def _assembler(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = next(p for p in parts if p["segment"] == 1)
                payload = http_payload(reassemble([(p["segment"], p["total"], p["block"]) for p in parts]))[1]
                digest = base32_sha1(payload)
                if first["payload_digest"] not in (None, digest):
                    raise ValueError(f"the payload of {origin} doesn't have its digest")
                rows.append((origin, first["type"], first["target_uri"], first["row_id"], None, None, None, origin, None, len(payload), digest, payload if with_payload else None))
            if rows:
                yield _batch(rows)

    return run


def read_warc(spark: SparkSession, folder: str, files: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """Whole records of all archives in a folder, or of those listed: ``record_id, type, target_uri, row_id, refers_to, payload_bytes, payload_digest, payload``."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    if files is not None:
        archives = archives.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(files.select("file"), "file", "left_semi")
    bounded_batches(spark, 1)  # a file at a time
    parsed = Table(archives.select("content").mapInArrow(lean(_reader(with_payload)), RECORD), "warc-records").df
    bounded_batches(spark, 16)
    segment = F.struct("segment", "total", "block", "type", "target_uri", "row_id", "payload_digest")
    grouped = parsed.filter("segment is not null").groupBy("origin").agg(F.collect_list(segment).alias("parts"))
    whole = parsed.filter("segment is null").unionByName(grouped.mapInArrow(lean(_assembler(with_payload)), RECORD))
    return whole.select("record_id", "type", "target_uri", "row_id", "refers_to", "payload_bytes", "payload_digest", "payload")


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch_path(spark, "warc")
    files = write_warc(pages, folder)
    back = read_warc(spark, folder, files, with_payload=False)
    return back.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT t, max(page_id) AS ref FROM p GROUP BY t
), d AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1), '' ORDER BY k, s DESC) AS digest
  FROM (SELECT DISTINCT h FROM p) u,
       LATERAL (SELECT k, CAST('0x' || substr(u.h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) AS v FROM range(8) r(k)) b,
       (SELECT unnest([15, 10, 5, 0]) AS s) q
  GROUP BY h
)
SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN p.page_id = g.ref THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = g.ref THEN NULL ELSE g.ref END AS refers_to
FROM p JOIN g ON p.t = g.t JOIN d ON d.h = p.h
"""
