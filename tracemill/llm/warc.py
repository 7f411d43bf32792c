"""WARC files: a writer, and a sequential reader.

Each record is a gzip member of its own. The reader inflates member after member incrementally from a stream, frames the
block by the record's Content-Length, and checks the digests its header names. It never holds more of a file than a chunk
and the record at hand, and a damaged record gives an error row and doesn't end the file if a next member can be found.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import shared_path, table

CHUNK, MAGIC = 1 << 16, b"\x1f\x8b\x08"
RECORD = "file string, record_offset bigint, record_id string, type string, url string, date string, content_type string, length bigint, payload binary, digest_ok boolean, error string"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, url: str | None, block: bytes, record_id: str, date: str, content_type: str, payload: bytes | None = None) -> bytes:
    """One record as a gzip member. The url is written as it is; line ends in it would break the header and are refused."""
    if url is not None and re.search(r"[\r\n]", url):
        raise ValueError(f"line end in the url {url!r}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url)
    lines += [f"WARC-Block-Digest: {digest(block)}"]
    if payload is not None:
        lines.append(f"WARC-Payload-Digest: {digest(payload)}")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _members(stream: BinaryIO) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, content, error) of each gzip member. After a damaged one, reading goes on at the next place that looks like a member."""
    held, offset = b"", 0
    while True:
        if len(held) < len(MAGIC):
            held += stream.read(CHUNK)
        if not held:
            return
        start, inflate, out, error = offset, zlib.decompressobj(31), [], None
        while not inflate.eof:
            try:
                out.append(inflate.decompress(held))
            except zlib.error as e:
                error = f"gzip: {e}"
                break
            offset += len(held) - len(inflate.unused_data)
            held = inflate.unused_data if inflate.eof else stream.read(CHUNK)
            if not held and not inflate.eof:
                error = "gzip: truncated member"
                break
        yield start, b"".join(out), error
        if error:
            skip = int(offset == start)
            held, offset = held[skip:], offset + skip
            while (at := held.find(MAGIC)) < 0:
                offset += max(0, len(held) - 2)
                more = stream.read(CHUNK)
                if not more:
                    return
                held = held[-2:] + more
            held, offset = held[at:], offset + at


def _target(url: str | None) -> str | None:
    """The url as it stands in the header, without the angle brackets that version 1.0 puts around it."""
    return url[1:-1] if url and url.startswith("<") and url.endswith(">") else url


def parse(content: bytes) -> dict:
    """A record out of a member's content: header fields by lower-case name, block, and ``error``."""
    head, end, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        return {"error": "no WARC header"}
    folded: list[str] = []
    for line in lines[1:]:  # a line that begins with white space goes on with the field before it
        if line[:1] in (" ", "\t") and folded:
            folded[-1] += " " + line.strip()
        else:
            folded.append(line)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in folded)}
    length = fields.get("content-length", "")
    if not re.fullmatch(r"\d+", length):
        return fields | {"error": "no Content-Length"}
    n = int(length)
    block, error = rest[:n], None
    if len(block) < n:
        error = "block shorter than Content-Length"
    elif rest[n:] != b"\r\n\r\n":
        error = "no record end after Content-Length bytes"
    return fields | {"block": block, "error": error}


def payload_of(fields: dict) -> bytes:
    """What follows the HTTP header in a response; else the block."""
    block = fields.get("block", b"")
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        _, end, body = block.partition(b"\r\n\r\n")
        return body if end else block
    return block


def _agrees(named: str, data: bytes) -> bool | None:
    """Whether a digest, in base 32 or in hexadecimal, is that of the data; null for an algorithm that isn't known."""
    algorithm, _, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    own, value = hashlib.new(algorithm, data, usedforsecurity=False), value.strip()
    if len(value) == 2 * own.digest_size:
        return value.lower() == own.hexdigest()
    return value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def check_digests(fields: dict, payload: bytes) -> bool | None:
    """Whether the digests agree; null without one that can be checked.

    The payload digest of a revisit record, and of a segment, is that of another record's or of the whole payload: not checked."""
    named = [("warc-block-digest", fields.get("block", b""))]
    if fields.get("warc-type", "").lower() not in ("revisit", "continuation") and "warc-segment-number" not in fields:
        named.append(("warc-payload-digest", payload))
    checked = [a for key, data in named if key in fields and (a := _agrees(fields[key], data)) is not None]
    return all(checked) if checked else None


def read_stream(stream: BinaryIO, name: str) -> Iterator[tuple]:
    """Rows of ``RECORD`` for each record of a WARC file."""
    for offset, content, error in _members(stream):
        fields = parse(content)
        payload = payload_of(fields)
        yield (name, offset, fields.get("warc-record-id"), fields.get("warc-type"), _target(fields.get("warc-target-uri")), fields.get("warc-date"), fields.get("content-type"), len(fields.get("block", b"")), payload, check_digests(fields, payload), error or fields["error"])


def _file_system(path: str):
    """The file system that Spark would take for the path, and the path in it: the driver resolves paths without a scheme."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without lies on the cluster's default file system, as anything Spark writes there."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return path
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(path)).toString()


def read_warc(paths: DataFrame) -> DataFrame:
    """``RECORD`` rows of the files named by ``paths(path)``, each file read by one task from its beginning to its end.

    A damaged record has its ``error`` named and what could be read of it. Null paths are passed over; a missing file
    fails the job; an empty file or table gives no rows; a path that repeats is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = _file_system(path)
                held, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for row in read_stream(stream, path):
                        held.append(row)
                        size += row[7] + 500
                        if size > 1 << 22:
                            yield _batch(held)
                            held, size = [], 0
                if held:
                    yield _batch(held)

    return paths.where("path is not null").select("path").mapInArrow(run, RECORD)


_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as response records, one file for each partition; returns ``(path)``.

    Record ids follow from page_id. A null html is written as an empty payload, a null url as no target. A url is written as
    it is, so that other readers see it, but for line ends, which no record can hold: they are percent-encoded, and come
    back so. Repeated rows are
    records each, with equal ids; an empty table gives no files; other columns are left out, whatever their names. Each
    task attempt writes a name of its own, and only files of attempts that succeeded are named in the result, which is
    materialised, so that an executor lost later loses nothing."""

    spark = pages.sparkSession
    folder = resolved(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _file_system(folder)
        fs.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        count = 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in batches:
                for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    body = (html or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: " + str(page).encode() + b"\r\n\r\n" + body
                    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                    out.write(record("response", target, block, str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}")), date, "application/http; msgtype=response", body))
                    count += 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"])], ["path"])

    written = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "path string")
    at = shared_path(spark, "warc-files")
    written.write.parquet(at)
    return spark.read.parquet(at)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC files in the shared folder, read back record by record: a row for each row of ``pages``.

    A null html comes back as an empty text; repeated rows come back each; an empty table gives no rows."""
    files = write_warc(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    count = files.count()
    return read_warc(files.repartition(max(1, count))).select("url", F.col("payload").cast("string").alias("html"), "type", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "digest_ok", "error")


ORACLE = """
SELECT url, coalesce(html, '') AS html, 'response' AS type, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, true AS digest_ok, NULL::VARCHAR AS error
FROM pages
"""
