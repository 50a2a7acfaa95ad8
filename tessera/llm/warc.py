"""Operator 4: WARC archives and the monolithic gzip normaliser.

Crawls are at times packed as one gzip stream around a whole file, which can only be
read from its start. The normaliser inflates such a stream once, piece by piece, rewrites
every record as a gzip member of its own and writes a sidecar index of the members' offsets, so
that any record can be read by itself afterwards.

Archives live in a folder all executors share. A task writes under a name of its own attempt and
returns it; only names that Spark committed to the manifest count, so lost and repeated
attempts leave no trace in the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import urllib.parse
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

PIECE = 1 << 20
LEVEL = 1
MIN_REVISIT = 1000
#: Bytes at which a writer goes on in a new archive: no task has to normalise or read a larger piece.
ARCHIVE_BYTES = 64 << 20
#: Bytes of archives that a task normalises or reads at least, unless one archive is larger.
TASK_BYTES = 8 << 20
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a URI or an absolute path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


# -- records -----------------------------------------------------------------------------


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, length: int, sha1: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(length))])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _VERSION + _header(fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def parse(raw: bytes) -> dict:
    """Page, payload length, digest, type and reference of one record, its digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    page = lambda name: (lambda x: None if x == "None" else int(x))(fields[name][len("<urn:page:") : -1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {page('warc-record-id')} doesn't match its digest")
    revisit = fields["warc-type"] == "revisit"
    return {"page_id": page("warc-record-id"), "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page("warc-refers-to") if revisit else None}


# -- normaliser --------------------------------------------------------------------------


def _inflated(source) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one member or several, in pieces."""
    z, begun = zlib.decompressobj(31), False
    while piece := source.read(PIECE):
        while piece:
            begun = True
            if out := z.decompress(piece, PIECE):
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z, begun = z.unused_data or piece, zlib.decompressobj(31), False
    if out := z.flush():
        yield out
    if begun:
        raise ValueError("the gzip stream is cut off")


def normalise(source, target) -> Iterator[tuple[int, int]]:
    """Rewrite the records of a gzip stream as members of their own; offset and length of each.

    The stream is inflated once. A record is passed on in pieces, so its size doesn't matter."""
    pieces, held, at = _inflated(source), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece:
            held.extend(piece)
        return piece is not None

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header is cut off")
        left = end + 4 + int(_fields(bytes(held[:end]))["content-length"]) + 4
        z, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        while left:
            if not held and not more():
                raise ValueError("a record is cut off")
            part = bytes(held[:left])
            del held[: len(part)]
            left -= len(part)
            size += target.write(z.compress(part))
        size += target.write(z.flush())
        yield at, size
        at += size


def read_record(source, offset: int, length: int) -> dict:
    """The record of one index entry, without what lies before it."""
    source.seek(offset)
    return parse(zlib.decompress(source.read(length), 31))


# -- Spark -------------------------------------------------------------------------------


def plan(pages: DataFrame, key: str, url: str, html: str, ws: Workspace, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Rows to write: page, url, body (null for revisits), payload length and SHA-1, what they refer to.

    Which payloads repeat is found from digests and keys alone. That table is written, so that the planner knows its size:
    while it is small bodies stay where they are, beyond that they move once, and often repeated ones are split."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha1"), F.length(body).cast("long").alias("size"))
    same = rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1 and head is not null")
    joined = rows.join(ws.save(same.drop("copies"), "repeated"), ["sha1", "size"], "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("body")).alias("body"), "size", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("head")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``plan``'s rows in monolithic archives of about ``archive_bytes`` below ``folder``; returns their ``path``, ``records`` and ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for x in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                if out is None:
                    path, n, size, z = f"{root}/{os.urandom(12).hex()}.warc.gz", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out = store.open_output_stream(path, compression=None)
                raw = record(x["page_id"], x["url"], x["body"] or b"", x["size"], x["sha1"], x["revisit"], x["refers_to"])
                size += _Counted(out).write(z.compress(raw))
                n += 1
                if size >= archive_bytes:
                    yield _closed(out, z, path, n, size)
                    out = None
        if out:
            yield _closed(out, z, path, n, size)

    return rows.mapInArrow(run, "path string, records long, bytes long")


def _closed(out, z, path: str, n: int, size: int) -> pa.RecordBatch:
    size += _Counted(out).write(z.flush())
    out.close()
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Archives with a member per record and their indexes; returns ``path``, ``index`` and ``records``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            for path in frame["path"]:
                name = f"{root}/{os.urandom(12).hex()}"
                n = 0
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(f"{name}.warc.gz", compression=None) as target, store.open_output_stream(f"{name}.index", compression=None) as index:
                    for offset, length in normalise(source, _Counted(target)):
                        index.write(json.dumps({"offset": offset, "length": length}).encode() + b"\n")
                        n += 1
                yield pd.DataFrame({"path": [f"{name}.warc.gz"], "index": [f"{name}.index"], "records": [n]})

    return manifest.select("path").mapInPandas(run, "path string, index string, records long")


class _Counted:
    """A stream whose ``write`` tells how many bytes it took."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each read through its index entry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for frame in frames:
            for path, index in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                with store.open_input_stream(index, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with store.open_input_file(path) as f:
                    for i in range(0, len(entries), 1000):
                        rows = [read_record(f, e["offset"], e["length"]) for e in entries[i : i + 1000]]
                        yield pa.RecordBatch.from_pylist(rows, shape)

    shape = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return manifest.select("path", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as WARC archives, normalise them and read every record back.

    Of rows with equal payloads of ``min_bytes`` or more the one with the largest key is a
    response and the others revisit it; rows that repeat that key are responses too. If all
    keys of such rows are null, all are responses; a null key beside others revisits. A null
    payload is empty, a null url has no header. Payloads of any length are read whole; they are inflated and rewritten in
    pieces. Other columns, whatever their names, are neither read nor returned. An empty table gives no archive and no row. ``folder`` (a shared one) keeps the archives; by default they go with the session."""
    ws = Workspace(pages.sparkSession, "warc")
    folder = (folder or ws.root).rstrip("/")
    raw = ws.save(write_archives(plan(pages, key, url, html, ws, min_bytes), f"{folder}/raw", archive_bytes), "raw-manifest")
    # a task for so many bytes of archives, not for each of many small ones
    n = max(1, -(-(raw.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    whole = ws.save(normalise_archives(raw.repartition(n), f"{folder}/records"), "manifest")
    if folder == ws.root:
        ws.drop("raw")
    return read_archives(whole.repartition(n), folder).withColumnRenamed("page_id", key)
