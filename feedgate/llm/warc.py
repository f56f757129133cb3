"""WARC archives written and read as a chunked record table.

Writing: every row becomes a gzip member of an archive in the shared folder, its payload encoded and
compressed piece by piece. Of rows with equal payloads (by SHA-1) of at least MIN_REVISIT bytes, the
one with the largest id is written in full, the others as revisit records that refer to it. Which
rows those are is a maximum per digest, aggregated before it is shuffled; the join back to the rows
is one that adaptive execution splits where a digest is frequent. Only archives that a finished task
has listed are read, so a repeated task leaves at most an archive that nobody looks at.

Reading: archives are streamed. A record of any size comes out as rows of (record, chunk number) with
at most CHUNK_BYTES of payload, each with the length and SHA-1 of the payload up to its end. So the
last chunk tells a record's size and digest, and no record is ever whole in memory.

Defined results: a null payload is empty; a null URL has no target; rows with the same id that share
the largest id of their payload are all written in full; a null id never is the largest; records
without payload have one empty chunk. A stored payload that does not fit its digest is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgate.llm.common import arrow_rows, small_batches
from feedgate.sources.scratch import new_path, save

MIN_REVISIT = 1000
CHUNK_BYTES = 256 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024
_PIECE_CHARS = 64 * 1024
_BATCH_BYTES = 4 * 1024 * 1024
_LEVEL = 4
#: Captures carry a fixed time, so that equal tables give equal archives.
DATE = "2024-01-01T00:00:00Z"

CHUNKS = (
    "archive string, record_no long, record_id string, record_type string, target_uri string, refers_to string, "
    "chunk_no long, chunk binary, payload_bytes long, payload_digest string, is_last boolean"
)
_CHUNK_FIELDS = pa.schema(
    [
        ("archive", pa.string()),
        ("record_no", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("chunk_no", pa.int64()),
        ("chunk", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("is_last", pa.bool_()),
    ]
)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file that Spark and executors share."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", uri)))


def _pieces(text: str) -> Iterator[bytes]:
    for at in range(0, len(text), _PIECE_CHARS):
        yield text[at : at + _PIECE_CHARS].encode("utf-8", "surrogatepass")


def _urn(name: int | None) -> str:
    return f"<urn:page:{'null' if name is None else name}>"


def _header(value: str) -> str:
    """One line: what could end it is written as in URLs."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def write_record(out: BinaryIO, name, url: str | None, text: str, size: int, digest: str, refers_to) -> None:
    """Appends a response, or a revisit if `refers_to` is given, as one gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(name)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *(
            [
                f"WARC-Refers-To: {_urn(refers_to)}",
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            ]
            if revisit
            else []
        ),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(head) + (0 if revisit else size)}",
    ]
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    out.write(packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + head))
    if not revisit:
        for piece in _pieces(text):
            out.write(packer.compress(piece))
    out.write(packer.compress(b"\r\n\r\n"))
    out.write(packer.flush())


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the written list of archives: archive, records."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    large = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    large = save(large.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("again"), "first"), "warc-copies")
    joined = rows.join(large, F.col("digest") == F.col("again"), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    ready = joined.select("id", "url", "size", "digest", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, records = None, "", 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records]})

        for row in arrow_rows(batches, "id", "url", "payload", "size", "digest", "refers_to"):
            if out is None:
                name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            page, url, text, size, digest, refers_to = row
            write_record(out, page, url, text or "", size, digest, refers_to)
            records += 1
            if out.tell() >= ARCHIVE_BYTES:
                out.close()
                out = None
                yield listed()
        if out is not None:
            out.close()
            yield listed()

    archives = save(ready.mapInArrow(write, "archive string, records long"), "warc-list")
    return archives.withColumn("archive", F.concat(F.lit(f"{folder}/"), F.col("archive")))


# ---------------------------------------------------------------- reading


class _Record:
    """A record's header, and its payload as a stream of chunks."""

    def __init__(self, stream: BinaryIO, first: bytes) -> None:
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        self.stream = stream
        self.fields = _fields(stream)
        self.left = int(self.fields["content-length"])
        self.declared, self.http_size = self.fields.get("warc-payload-digest"), 0
        if self.fields.get("content-type", "").startswith("application/http"):
            self._line()
            while (line := self._line()).strip():
                key, _, value = line.partition(b":")
                if key.strip().lower() == b"content-length":
                    self.http_size = int(value)

    def _line(self) -> bytes:
        line = self.stream.readline(self.left)
        self.left -= len(line)
        return line

    def chunks(self, size: int) -> Iterator[tuple[int, bytes, int, str, bool]]:
        """(number, bytes, payload length so far, SHA-1 so far, whether it is the last)."""
        if self.fields["warc-type"] == "revisit":
            yield 0, b"", self.http_size, _hex(self.declared), True
        else:
            running, done, number = hashlib.sha1(), 0, 0
            while True:
                data = self.stream.read(min(size, self.left))
                if self.left and not data:
                    raise ValueError("a WARC record ends early")
                self.left -= len(data)
                done += len(data)
                running.update(data)
                if not self.left and self.declared and running.hexdigest() != _hex(self.declared):
                    raise ValueError(f"{self.fields['warc-record-id']}: payload and digest differ")
                yield number, data, done, running.hexdigest(), not self.left
                number += 1
                if not self.left:
                    break
        while self.left:
            self.left -= len(self.stream.read(min(self.left, size)))
        self.stream.readline()
        self.stream.readline()


def _fields(stream: BinaryIO) -> dict[str, str]:
    result = {}
    while (line := stream.readline()).strip():
        key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        result[key.strip().lower()] = value.strip()
    return result


def _hex(declared: str) -> str:
    return base64.b32decode(declared.removeprefix("sha1:")).hex()


def read_archive(stream: BinaryIO, archive: str, chunk_bytes: int) -> Iterator[dict]:
    number = 0
    while first := stream.readline():
        record = _Record(stream, first)
        of = record.fields
        for chunk_no, data, done, digest, last in record.chunks(chunk_bytes):
            yield {
                "archive": archive,
                "record_no": number,
                "record_id": of["warc-record-id"],
                "record_type": of["warc-type"],
                "target_uri": of.get("warc-target-uri"),
                "refers_to": of.get("warc-refers-to"),
                "chunk_no": chunk_no,
                "chunk": data,
                "payload_bytes": done,
                "payload_digest": digest,
                "is_last": last,
            }
        number += 1


def read_chunks(archives: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The CHUNKS rows of every record of the listed archives; a task for each archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (archive,) in arrow_rows(batches, "archive"):
            store, path = _store(archive)
            held, size = [], 0
            with store.open_input_file(path) as raw, gzip.open(raw) as stream:
                for row in read_archive(stream, archive, chunk_bytes):
                    held.append(row)
                    size += len(row["chunk"]) + 300
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _CHUNK_FIELDS)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, _CHUNK_FIELDS)

    tasks = max(1, archives.count())
    return archives.select("archive").repartition(tasks).mapInArrow(read, CHUNKS)


def records(chunks: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """One row per record of rows written here, from its last chunk."""
    number = lambda urn: F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return chunks.where("is_last").select(
        number(F.col("record_id")).alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    return records(read_chunks(write_archives(pages)))
