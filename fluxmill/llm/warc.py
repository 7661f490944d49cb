"""WARC archives written from rows and read back as a chunked record table.

Writing: every row becomes a WARC/1.1 record, a gzip member of its own, in an
archive in the shared folder.  Of rows with equal payloads the one with the
largest id is the response, the others are revisit records that refer to it.
Each attempt of a task writes under a name of its own and only the manifest of
the attempts that Spark accepted is read, so lost executors leave strays, never
doubles.

Reading: archives stream through a bounded buffer; a payload comes out as rows
of record id and chunk number with the digest of all bytes so far, so no task
ever holds a whole record.  The last chunk's running digest must equal the one
in the header.

Null payloads count as empty; null ids get records but refer to nothing and are
never referred to unless all of their group are null (then all are responses);
rows that repeat the response's id are responses, too; null addresses leave the
target out; an empty table gives an empty result; extra columns are ignored.
The shared folder must be one that pyarrow can open (file, s3, gs, hdfs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmill.llm.common import join_small, scratch, stash

ARCHIVE_BYTES = 64 << 20  # payload bytes after which a task begins another archive
CHUNK_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:record:"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path)))


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _head(kind: str, ident: int | None, url: str | None, digest: str, refers_to: int | None, size: int, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if ident is None else ident}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class ArchiveWriter:
    """One archive file; a record's payload is deflated and digested piece by piece."""

    def __init__(self, folder: str, level: int):
        system, where = _open(folder)
        system.create_dir(where, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self._out = system.open_output_stream(_open(self.path)[1], compression=None)
        self._level, self.records, self.payload = level, 0, 0

    def add(self, kind: str, ident: int | None, url: str | None, digest: str, refers_to: int | None, payload: memoryview, date: str) -> None:
        head, http = _head(kind, ident, url, digest, refers_to, len(payload), date)
        deflate, seen = zlib.compressobj(self._level, zlib.DEFLATED, 31), hashlib.sha1()
        self._out.write(deflate.compress(head + http))
        for at in range(0, len(payload), CHUNK_BYTES):
            piece = payload[at : at + CHUNK_BYTES]
            seen.update(piece)
            if kind == "response":
                self._out.write(deflate.compress(piece))
        if base64.b32encode(seen.digest()).decode() != digest:
            raise ValueError(f"record {ident}: the payload doesn't have its digest")
        self._out.write(deflate.compress(b"\r\n\r\n") + deflate.flush())
        self.records += 1
        self.payload += len(payload)

    def close(self) -> None:
        self._out.close()


def label(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(ident, url, payload, sha1, kind, refers_to): which rows are responses and which revisit another."""
    rows = pages.select(pages[ident].cast("long").alias("ident"), pages[url].alias("url"), F.coalesce(pages[payload].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    same = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("ident").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "size", "first")
    same = stash(same, "warc-same")
    out = join_small(rows, same, ["sha1", "size"], "left", same.count())
    again = F.col("first").isNotNull() & ~F.col("ident").eqNullSafe(F.col("first"))
    return out.select("ident", "url", "payload", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(labelled: DataFrame, folder: str, level: int = 1, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``label`` as archives below ``folder``; returns the manifest (path, records, payload_bytes), itself written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            idents, urls, digests, kinds, refers = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ident", "url", "sha1", "kind", "refers_to"))
            payloads = batch.column(batch.schema.get_field_index("payload"))
            for k in range(batch.num_rows):
                if now is None:
                    now = ArchiveWriter(folder, level)
                now.add(kinds[k], idents[k], urls[k], base32_sha1(digests[k]), refers[k], memoryview(payloads[k].as_buffer()), date)
                if now.payload >= ARCHIVE_BYTES:
                    now.close()
                    done.append(now)
                    now = None
        if now is not None:
            now.close()
            done.append(now)
        yield pa.RecordBatch.from_arrays([pa.array([a.path for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.payload for a in done], pa.int64())], ["path", "records", "payload_bytes"])

    return stash(labelled.mapInArrow(run, "path string, records bigint, payload_bytes bigint"), "warc-manifest")


def _fields(stream: io.BufferedReader) -> dict[str, str] | None:
    """The next header's fields by lower-case name, or None at the end of the archive."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    out = {"": line.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def records(path: str, chunk: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunks of an archive's records, in order; one chunk is held at a time."""
    system, where = _open(path)
    with system.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw) as inflated, io.BufferedReader(inflated, 1 << 16) as stream:
        while (head := _fields(stream)) is not None:
            if not head[""].startswith("WARC/"):
                raise ValueError(f"{path}: no record where one should begin")
            start, left = 0, int(head["content-length"])
            http = {}
            while start < left and (line := stream.readline()) != b"\r\n":
                start += len(line)
                name, colon, value = line.decode("latin-1").partition(":")
                http[name.strip().lower()] = value.strip()
            left -= start + 2
            kind, seen, total, number = head["warc-type"], hashlib.sha1(), 0, 0
            base = {"record_id": head["warc-record-id"].strip("<>"), "ident": _number(head["warc-record-id"]), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": _number(head.get("warc-refers-to"))}
            named = head["warc-payload-digest"].removeprefix("sha1:")
            while True:
                piece = stream.read(min(chunk, left)) if left else b""
                if left and not piece:
                    raise ValueError(f"{path}: a record is cut short")
                left -= len(piece)
                seen.update(piece)
                total += len(piece)
                now = base64.b32encode(seen.digest()).decode()
                if not left and kind == "response" and (now != named or total != int(http["content-length"])):
                    raise ValueError(f"{path}: record {base['record_id']} doesn't have its digest")
                yield base | {"chunk_no": number, "chunk": piece, "seen_bytes": total, "seen_digest": now, "last": not left, "payload_bytes": int(http["content-length"]), "payload_digest": named}
                number += 1
                if not left:
                    break


_CHUNK = {"record_id": ("string", pa.string()), "ident": ("bigint", pa.int64()), "record_type": ("string", pa.string()), "target_uri": ("string", pa.string()), "refers_to": ("bigint", pa.int64()), "chunk_no": ("int", pa.int32()), "chunk": ("binary", pa.binary()), "seen_bytes": ("bigint", pa.int64()), "seen_digest": ("string", pa.string()), "last": ("boolean", pa.bool_()), "payload_bytes": ("bigint", pa.int64()), "payload_digest": ("string", pa.string())}


def read_archives(manifest: DataFrame, data: bool = True, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the manifest's archives (``data`` False: without the bytes). Archives are bounded, one task each."""
    fields = {n: t for n, t in _CHUNK.items() if data or n != "chunk"}
    many = max(1, manifest.count())

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, (_, t) in fields.items()], list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in records(path, chunk):
                    rows.append(r)
                    held += len(r["chunk"]) if data else 0
                    if held >= 8 * chunk or len(rows) >= 2000:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return manifest.select("path").repartition(many, "path").mapInArrow(run, ", ".join(f"`{n}` {t}" for n, (t, _) in fields.items()))


def roundtrip(pages: DataFrame, data: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read their chunk table back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(label(pages), folder), data)
