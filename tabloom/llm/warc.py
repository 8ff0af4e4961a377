"""WARC archives of pages, with repeated payloads as revisits, and a chunked reader.

Writing. A payload is written once, in the response record of the smallest page id that has
it; the others become revisit records that name this record. Which page that is follows from a grouping by
(SHA-1, length), so only digests are shuffled, unless the table of repeated digests is too large to be
broadcast. Each task streams its rows into gzip archives, one member per record, and starts a new archive
at ``ROLL_BYTES``.

Reading. Archives are read as streams. A record becomes rows (record, chunk number): at
most ``CHUNK_BYTES`` of payload each, with the SHA-1 and length of the payload up to the end of that chunk. No
record is held whole, neither here nor by a consumer of the rows; the last chunk has the digest of the record.

Defined cases: a null payload counts as empty; an empty payload has one empty chunk; a page without id never
wins over one with id, and pages without ids only are all responses; rows equal in id and payload are all responses
if their id is the smallest; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import files
from tabloom.llm.common import in_slices, stage, text_of
from tabloom.session import scratch_path

ROLL_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
MIN_REVISIT_BYTES = 0
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records bigint, bytes bigint"
CHUNKS = (
    "archive string, record bigint, page_id bigint, record_type string, refers_to bigint, stated_digest string, "
    "chunk bigint, chunk_bytes bigint, payload_bytes bigint, payload_digest string"
)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def header(page_id, uri, kind: str, digest: str, length: int, refers_to) -> bytes:
    """The header of a record up to and including the empty line."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines.append(f"WARC-Record-ID: {record_id(page_id) if page_id is not None else '<urn:page:unknown>'}")
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%20" for c in uri))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def plan_records(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """``page_id, url, digest, first_id, html`` per page; ``first_id`` is set for revisits."""
    payload = text_of(f"`{payload_col}`")
    digests = stage(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"),
                                 F.octet_length(payload).alias("length")), "digests")
    repeated = digests.filter(F.col("length") >= least).groupBy("digest", "length").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1 AND first_id IS NOT NULL")
    repeated = stage(repeated.select(F.col("digest").alias("_digest"), F.col("length").alias("_length"), "first_id"), "repeated")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{uri_col}`").cast("string").alias("url"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("length"), payload.alias("html"),
    )
    met = rows.join(repeated, (F.col("digest") == F.col("_digest")) & (F.col("length") == F.col("_length")), "left")
    first = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return met.select("page_id", "url", "digest", first.alias("first_id"), "html")


def write_archives(records: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the planned records; returns the table of archives (``MANIFEST``), which is
    staged, so the work is done when this returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in in_slices(batches, "html") for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            records = size = 0
            with files.writing(folder, ".warc.gz") as (out, name):
                while row is not None and size < roll:
                    page_id, url, digest, first_id, html = row
                    kind, payload = ("response", memoryview(html)) if first_id is None else ("revisit", memoryview(b""))
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    parts = [packer.compress(header(page_id, url, kind, base32(bytes.fromhex(digest)), len(payload), first_id))]
                    for at in range(0, len(payload), CHUNK_BYTES):
                        parts.append(packer.compress(payload[at:at + CHUNK_BYTES]))
                        if len(parts) > 16:
                            out.write(b"".join(parts))
                            size += sum(map(len, parts))
                            parts = []
                    parts += [packer.compress(b"\r\n\r\n"), packer.flush()]
                    out.write(b"".join(parts))
                    size += sum(map(len, parts))
                    records += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], ["archive", "records", "bytes"])

    ready = records.select("page_id", "url", "digest", "first_id", F.col("html").cast("binary").alias("html"))
    return stage(ready.mapInArrow(run, MANIFEST), "archives")


class _Member:
    """Bytes of a gzip stream, decompressed a piece at a time across member borders."""

    def __init__(self, source, piece: int):
        self.source, self.piece, self.ready = source, piece, bytearray()
        self.packed, self.inflater, self.begun = b"", zlib.decompressobj(31), False

    def _more(self) -> bool:
        while True:
            if self.inflater.eof:
                # What follows the member; the tail may repeat it and is not looked at.
                self.packed, self.inflater, self.begun = self.inflater.unused_data, zlib.decompressobj(31), False
            if not self.packed:
                self.packed = self.source.read(self.piece)
                if not self.packed:
                    # Output may be waiting although all input is taken.
                    made = self.inflater.decompress(b"", self.piece) if self.begun else b""
                    if not made and self.begun and not self.inflater.eof:
                        raise EOFError("the archive ends inside a member")
                    self.ready += made
                    return bool(made)
            made, self.begun = self.inflater.decompress(self.packed, self.piece), True
            self.packed = b"" if self.inflater.eof else self.inflater.unconsumed_tail
            if made:
                self.ready += made
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the stream."""
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                return None
        found = bytes(self.ready[:at])
        del self.ready[:at + 2]
        return found

    def take(self, most: int) -> bytes:
        """At most ``most`` bytes; fewer only at the end of the stream."""
        while len(self.ready) < most and self._more():
            pass
        found = bytes(self.ready[:most])
        del self.ready[:most]
        return found


def _page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_chunks(source, chunk_bytes: int) -> Iterator[tuple]:
    """Chunks of an open archive: record number, header fields, chunk number, bytes, length and SHA-1 so far."""
    stream, record = _Member(source, 1 << 16), 0
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line:
                raise ValueError(f"record {record} does not begin with a version line")
            continue
        fields = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        left, done, number, digest = int(fields.get("content-length", 0)), 0, 0, hashlib.sha1()
        while True:
            data = stream.take(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise EOFError(f"record {record} ends early")
            digest.update(data)
            left, done = left - len(data), done + len(data)
            yield record, fields, number, data, done, base32(digest.digest())
            number += 1
            if not left:
                break
        record += 1


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = False) -> DataFrame:
    """The chunked record table of the archives named in column ``archive``.

    ``payload_bytes`` and ``payload_digest`` are those of the payload up to the end of the chunk;
    ``payload=True`` adds the bytes of each chunk as column ``data``.
    """
    schema = CHUNKS + (", data binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        # A batch of rows holds no more than a few chunks of payload.
        most_rows = 4 if payload else 4_096
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with files.reading(archive) as source:
                    for record, fields, number, data, done, digest in read_chunks(source, chunk_bytes):
                        refers = fields.get("warc-refers-to")
                        rows.append((
                            archive, record, _page_of(fields.get("warc-record-id", "")), fields.get("warc-type"),
                            _page_of(refers) if refers else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                            number, len(data), done, digest, *([data] if payload else []),
                        ))
                        if len(rows) == most_rows:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    kinds = {"record": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "chunk": pa.int64(), "chunk_bytes": pa.int64(),
             "payload_bytes": pa.int64(), "data": pa.binary()}

    def _batch(rows, names):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)

    spread = archives.select("archive").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(run, schema)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest are read off the last chunk of a record. A revisit has no payload of its own and gets those of
    the record it refers to; responses that others refer to are few, so only their rows are joined.
    """
    last = F.max_by(F.struct("payload_bytes", "payload_digest"), "chunk").alias("whole")
    records = chunks.groupBy("archive", "record").agg(
        F.first("page_id").alias("page_id"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"),
        F.first("stated_digest").alias("stated"), last)
    records = stage(records.select("page_id", "record_type", "refers_to", "stated", "whole.*"), "records")
    responses = records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    revisits = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated")
    wanted = stage(revisits.select(F.col("refers_to").alias("_id")).distinct(), "wanted")
    origins = stage(records.filter("record_type = 'response'").join(wanted, F.col("page_id") == F.col("_id"), "left_semi").select(
        F.col("page_id").alias("_id"), F.col("payload_bytes"), F.col("payload_digest")).distinct(), "origins")
    met = revisits.join(origins, (F.col("refers_to") == F.col("_id")) & (F.col("stated") == F.col("payload_digest")), "left")
    return responses.unionAll(met.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives to the shared folder and read them back as records."""
    spark: SparkSession = pages.sparkSession
    archives = write_archives(plan_records(pages, **options), scratch_path(spark, "warc"))
    return records_of(read_archives(archives))
