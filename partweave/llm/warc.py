"""WARC archives: one gzip member per record, written and read as Spark jobs.

Writing: payload digests are computed and grouped in Spark (the smallest page id
of a digest is its response, others are revisits), and an Arrow pass turns each row
into a record compressed as a gzip member of its own. Members are gathered to archives
of about ``archive_bytes``; each is one row of Spark's text writer and one file. That
writer ends a row with a zero byte: the last byte of an archive is the high byte of its
last member's length, which is zero below 16 MB, so it is left to the writer. A longer
member is kept whole and followed by one zero of padding.

Reading: archives of up to ``whole_bytes`` come from Spark's binary file source, so any
path that Spark can open will do; longer ones, as others write them, are opened by the
tasks and read in small pieces. Either way a task reads in sequence: bytes are fed
to an incremental decompressor, member by member, records are framed by
Content-Length, and block and payload digests are verified as the bytes pass. A
revisit whose referent is not in the archives with the same digest is an error.

Cases: a null html is an empty payload; page ids may be null (such a page is
a response only if its digest has no id at all, else a revisit); repeated rows
with the smallest page id are responses each, with record ids of their own; an empty
table gives no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, scratch_path, stored
from partweave.llm.hashing import text_batches

LEVEL = 6
#: Of an archive that is written, but for a single longer record.
ARCHIVE_BYTES = 8 << 20
#: Archives up to this size travel as one binary value.
WHOLE_BYTES = 64 << 20
FEED = 64 << 10
CRLF = b"\r\n"
RECORD = (
    "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, refers_record string, payload binary"
)


class WarcError(ValueError):
    """An archive that breaks the format or a digest that does not hold."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """Unique whatever the page ids: ``row`` numbers the rows that are written."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _page_of(record: str) -> int | None:
    text = record[len("<urn:page:") : -1].partition(":")[0]
    return int(text) if text else None


def record_bytes(page_id: int | None, row: int, url: str | None, payload: bytes, refers: str | None, date: str) -> bytes:
    """One record, uncompressed. A revisit (``refers`` is the response's record id) has
    the header block only; its full payload's length and digest stand in the headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", record_id(page_id, row)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if refers:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + CRLF + block + CRLF + CRLF


def member(record: bytes) -> bytes:
    """A gzip member without a time stamp, so equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members(source: io.BufferedIOBase) -> Iterator[bytes]:
    """The decompressed members of an archive in turn. The source is read in small
    steps; no more than a step and one record is held."""
    ahead = b""
    while True:
        # Padding between members.
        ahead = ahead.lstrip(b"\0") or source.read(FEED).lstrip(b"\0")
        while not ahead:
            step = source.read(FEED)
            if not step:
                return
            ahead = step.lstrip(b"\0")
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not ahead:
                ahead = source.read(FEED)
                if not ahead:
                    raise WarcError("the last member is cut off")
            try:
                parts.append(unpack.decompress(ahead))
            except zlib.error as error:
                raise WarcError(str(error)) from error
            ahead = unpack.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple:
    """The columns of RECORD; raises WarcError where framing or a digest fails."""
    end = record.find(CRLF + CRLF)
    lines = record[: max(end, 0)].split(CRLF)
    if end < 0 or not lines[0].startswith(b"WARC/"):
        raise WarcError("no record header")
    headers = dict(line.decode().split(": ", 1) for line in lines[1:])
    size, begin = int(headers["Content-Length"]), end + 4
    # A view: a large record is not copied again.
    block, tail = memoryview(record)[begin : begin + size], record[begin + size :]
    if len(block) != size or tail != CRLF + CRLF:
        raise WarcError("Content-Length does not frame the record")
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise WarcError("block digest")
    payload = block[record.find(CRLF + CRLF, begin) + 4 - begin :]
    kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(headers["WARC-Payload-Length"])
    if kind == "response" and (digest(payload) != stated or len(payload) != length):
        raise WarcError("payload digest")
    refers = headers.get("WARC-Refers-To")
    return (
        headers["WARC-Record-ID"],
        _page_of(headers["WARC-Record-ID"]),
        headers.get("WARC-Target-URI", ""),
        length,
        stated,
        kind,
        _page_of(refers) if refers else None,
        refers,
        payload if kind == "response" else None,
    )


def _packed(archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held = [], 0

        def archive() -> pa.RecordBatch:
            data = b"".join(ready)
            return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data[-1] == 0 else data], pa.binary())], ["archive"])

        for whole in batches:
            for batch in text_batches(whole, "html"):
                for row in batch.to_pylist():
                    refers = record_id(row["first"]["page_id"], row["first"]["row"]) if row["revisit"] else None
                    packed = member(record_bytes(row["page_id"], row["row"], row["url"], (row["html"] or "").encode(), refers, date))
                    if ready and held + len(packed) > archive_bytes:
                        yield archive()
                        ready, held = [], 0
                    ready.append(packed)
                    held += len(packed)
        if ready:
            yield archive()

    return run


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write a record per page below ``path``; ``date`` (default: now) is their WARC-Date."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # The row numbers are the same each time: they follow the splits of the input.
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    first = rows.groupBy("digest").agg(F.min(place).alias("first"))
    known = rows.join(first.hint("shuffle_hash"), "digest").select(
        "page_id", "row", "url", "html", "first", (~F.col("page_id").eqNullSafe(F.col("first.page_id"))).alias("revisit"),
    )
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    packed = arrow_pass(known, _packed(archive_bytes, date), "archive binary")
    # Bytes pass through the cast unchanged.
    packed.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str, *, with_payload: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The records of all archives below ``path``."""

    def records(source: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for record in members(source):
            parsed = parse_record(record)
            # Without payloads nothing keeps a record alive.
            rows.append(parsed if with_payload else parsed[:-1])
            held += len(record) if with_payload else 0
            if len(rows) == 500 or held > FEED << 4:
                yield _batch(rows, with_payload)
                rows, held = [], 0
        yield _batch(rows, with_payload)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from records(io.BytesIO(content.as_buffer()))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, name = pyarrow.fs.FileSystem.from_uri(uri)
                with system.open_input_stream(name, compression=None) as source:
                    yield from records(source)

    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    short = arrow_pass(files.where(F.col("length") <= whole_bytes).select("content"), whole, schema)
    # `file:/x` is not yet a URI to everyone.
    name = F.regexp_replace("path", "^file:/+", "file:///")
    long = arrow_pass(files.where(F.col("length") > whole_bytes).select(name.alias("path")), opened, schema)
    return short.unionByName(long)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    keep = len(names) if with_payload else len(names) - 1
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(keep)], names[:keep])


def dangling_revisits(records: DataFrame) -> DataFrame:
    """(refers_record, payload_digest) of revisits whose response is not there."""
    asked = records.where("record_type = 'revisit'").select("refers_record", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), "payload_digest")
    return asked.join(held, ["refers_record", "payload_digest"], "left_anti")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    records = stored(read_archives(spark, path), "records")
    if dangling := dangling_revisits(records).limit(1).collect():
        raise WarcError(f"no response {dangling[0].refers_record} with this digest")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
