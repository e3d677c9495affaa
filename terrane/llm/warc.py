"""WARC archives: a writer, and a reader that splits gzipped archives anywhere.

Every record is one gzip member, as the format asks. The writer lets Spark's text sink commit the members, so a lost
executor's half-written files never show; the sink's line separator is the zero byte that ends the member anyway
(the top byte of its length; records of 16 MB and more get an empty member after them). The reader deals out byte
ranges of all files. A task looks for gzip magic in its range, accepts a place if the member there decodes to a WARC
header, reads on to the member's end (also beyond its range) and goes on behind it: a record belongs to the range in
which it starts. Memory is bounded by the largest record.

Of records with equal payloads of ``least_bytes`` or more, the one with the largest page_id is a response and the
others revisit it. Payload digests are pre-aggregated; only digests that repeat meet the pages again, by a broadcast
if their number is below a checked bound and by a join that Spark can split otherwise.

Defined cases: null html is an empty payload; a null url has no target URI; rows of one payload that share the
largest page_id are all responses; a row without page_id revisits like any other but is never revisited; an empty
table makes an archive without records; very long payloads are records of several pieces; a record that is damaged or
cut off behind its header is an error and never passed over; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, only_columns, small

BROADCAST_ROWS = 500_000
RANGE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")
LEVEL = 2


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    """A gzip member, or two, that end in a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for page_id, url, html, target, repeated in zip(*(batch.column(i) for i in range(5)), strict=True):
            page_id, target = page_id.as_py(), target.as_py()
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            revisit = bool(repeated.as_py()) and target is not None and target != page_id
            out.append(gzip_member(record(page_id, url.as_py(), payload, target, revisit))[:-1])
            held += len(out[-1])
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """Write a record for each row to archives below ``path``."""
    narrow = only_columns(pages, page_id, url, html).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    payload = F.coalesce("html", F.lit(""))
    narrow = narrow.withColumn("key", F.when(F.octet_length(payload) >= least_bytes, F.sha1(payload)))
    repeats = narrow.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("target")).where("n > 1").select("key", "target")
    joined = narrow.join(F.broadcast(repeats) if small(repeats, BROADCAST_ROWS) else repeats, "key", "left")
    rows = joined.select("page_id", "url", "html", "target", F.col("target").isNotNull().alias("repeated"))
    members = rows.mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class _Source:
    """Bytes of a file from a place onwards, read in pieces and let go behind the reader."""

    def __init__(self, file, at: int, size: int, piece: int = 1 << 20) -> None:
        self.file, self.base, self.size, self.piece, self.data = file, at, size, piece, bytearray()

    def until(self, end: int) -> bool:
        """Have all bytes before ``end``, if the file has them."""
        end = min(end, self.size)
        while self.base + len(self.data) < end:
            got = self.file.read_at(max(self.piece, end - self.base - len(self.data)), self.base + len(self.data))
            if not got:
                return False
            self.data += got
        return True

    def drop(self, at: int) -> None:
        if at - self.base > self.piece:
            del self.data[: at - self.base]
            self.base = at


def _decode(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The content of the member at ``at`` and its end, or None if no record starts there; a damaged record is an error."""
    unpack, parts, head, pos = zlib.decompressobj(31), [], b"", at
    try:
        while not unpack.eof:
            step = 1 << 14 if len(head) < 7 else source.piece
            source.until(pos + step)
            data = bytes(source.data[pos - source.base : pos - source.base + step])
            if not data:
                break
            parts.append(unpack.decompress(data))
            pos += len(data) - len(unpack.unused_data)
            if len(head) < 7:
                head += parts[-1][:7]
                if not b"WARC/1.".startswith(head[:7]):
                    return None
    except zlib.error:
        pass
    if len(head) < 7:
        return None
    if not unpack.eof:
        raise ValueError(f"the record at byte {at} is damaged or cut off")
    return b"".join(parts), pos


def records_in(file, size: int, begin: int, end: int) -> Iterator[bytes]:
    """The records whose members start in ``[begin, end)`` of a file of ``size`` bytes."""
    source, at = _Source(file, begin, size), begin
    while at < end:
        source.until(min(at + source.piece, end + len(MAGIC) - 1))
        found = source.data.find(MAGIC, at - source.base)
        if found < 0 or source.base + found >= end:
            ahead = source.base + len(source.data)
            if ahead >= min(end + len(MAGIC) - 1, size):
                return
            at = max(at, ahead - len(MAGIC) + 1)
        elif (got := _decode(source, source.base + found)) is None:
            at = source.base + found + 1
        else:
            yield got[0]
            at = got[1]
        source.drop(at)


def _parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(name, ""))) else None
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest_of(payload) != digest or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(wanted: list[str]):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds[n]) for n in wanted])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with _open(r["path"]) as file:
                    for data in records_in(file, r["size"], r["begin"], r["end"]):
                        row = _parse(data)
                        held += len(row["payload"] or b"") if "payload" in wanted else 0
                        rows.append({n: row[n] for n in wanted})
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, columns: list[str] | None = None) -> DataFrame:
    """All records of the archives below ``path``; tasks own byte ranges."""
    fields = [f.strip() for f in SCHEMA.split(",")]
    wanted = columns or [f.split()[0] for f in fields]
    schema = ", ".join(next(f for f in fields if f.split()[0] == n) for n in wanted)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.col("length").alias("size"))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("size", F.lit(1)) - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + range_bytes, "size"))
    total = files.agg(F.sum("size")).first()[0] or 0
    ranges = ranges.repartition(max(1, min(10_000, max(spark.sparkContext.defaultParallelism, -(-total // range_bytes)))), "path", "begin")
    return ranges.mapInArrow(_reader(wanted), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0, **more) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: what a record says of each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least_bytes=least_bytes, **more)
    return read(spark, path, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _base32(hex40: str) -> str:
    bits = f"list_reduce(list_transform(range(1, 41), lambda i: right('000' || bin(instr('0123456789abcdef', substr({hex40}, i, 1)) - 1), 4)), lambda x, y: x || y)"
    value = f"list_sum(list_transform(range(1, 6), lambda j: (1 << (5 - j)) * CAST(substr({bits}, 5 * k + j, 1) AS BIGINT)))"
    return f"list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST({value} AS BIGINT), 1)), lambda x, y: x || y)"


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS target FROM pages),
h AS (SELECT *, sha1(html) AS sha FROM p),
b AS (SELECT *, {_base32('sha')} AS payload_digest FROM h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target = page_id THEN NULL ELSE target END AS refers_to
FROM b
"""
