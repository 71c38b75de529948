"""WARC archives with a two-level capture index.

Method: each page becomes a record in its own gzip member of a WARC file.  The captures' keys, the
URLs with their host reversed, are sorted over all files and written as lines into compressed
blocks; a sparse directory holds the first key and the place of each block, and a short list holds
the first key of each index file.  A look-up searches list and directory by bisection, reads one
block by range, searches it, and reads the record by range.

Defined cases: a null html is an empty payload; a null or empty url has the key ``-``; pages that
share a url are told apart by page_id, and rows repeated with their page_id by their place in the
archive; of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
largest page_id is the response (all rows that repeat it are), the others revisit it.  An empty
table gives no archives and no rows.  Extra columns are ignored.

Scale: payloads are never shuffled.  Digests are counted with map-side sums, so that a payload with
a third of all rows is one row per task; only digests that occur more than once go on, and they are
broadcast only if counted as few.  The list of index files has one row per file.  Archives and
index get unique names in the shared folder and only those in durable manifests are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
#: Bytes of a WARC file after which a task begins another; lines of an index block.
FILE_BYTES = 256 << 20
BLOCK_LINES = 512
_DATE = "2024-01-01T00:00:00Z"


def capture_key(url: str | None) -> str:
    """``https://www.a.example/x?q`` -> ``example,a,www)/x?q``; no scheme, port or case of the host."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        host = ""
    if not host:
        return _escaped(f"-{url or ''}")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return _escaped(f"{','.join(reversed(host.split('.')))}){path}")


def _escaped(key: str) -> str:
    """Keys stand in lines of fields."""
    return key.replace("\t", "%09").replace("\n", "%0A")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    own = uri.strip("<>").rpartition(":")[2]
    return int(own) if own else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit names the digest and the length of the payload that it leaves out."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body; the length must be right."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than it says")
    return headers, rest[:size]


def _member(raw: bytes) -> bytes:
    """A gzip member, as WARC readers expect one for each record."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; returns the durable list of captures: key, page_id, path, offset, size."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sized = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    large = sized.where(F.col("bytes") >= REVISIT_BYTES)
    copies = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1").select("digest", "first")
    copies = common.durable(copies, "copies")
    joined = common.join_checked(sized, copies, "digest", "left", copies.count())
    schema = "key string, page_id long, path string, offset long, size long"
    out = common.pa_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = common.filesystem(folder)
        stream = path = None
        place = 0
        for batch in common.slices(batches, 256):
            made = []
            for page_id, url, html, digest, first in zip(*(batch[x].to_pylist() for x in ("page_id", "url", "html", "digest", "first"))):
                if stream is None or place >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    else:
                        system.create_dir(at, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    stream, path, place = system.open_output_stream(f"{at}/{name}", compression=None), f"{folder}/{name}", 0
                revisit = first is not None and first != page_id
                raw = _member(make_record(page_id, url, html.encode(), bytes.fromhex(digest), first, revisit))
                stream.write(raw)
                made.append({"key": capture_key(url), "page_id": page_id, "path": path, "offset": place, "size": len(raw)})
                place += len(raw)
            yield pa.RecordBatch.from_pylist(made, schema=out)
        if stream is not None:
            stream.close()

    return common.durable(joined.select("page_id", "url", "html", "digest", "first").mapInArrow(write, schema), "captures")


def _line(key: str, page_id: int | None, path: str, offset: int, size: int) -> str:
    return "\t".join((key, "" if page_id is None else str(page_id), path, str(offset), str(size)))


class IndexFile:
    """An index file opened for look-ups: its directory is read at once, blocks by range on demand."""

    def __init__(self, path: str):
        self.system, self.at = common.filesystem(path)
        self.file = self.system.open_input_file(self.at)
        end = self.file.size()
        self.file.seek(end - 8)
        size = int.from_bytes(self.file.read(8), "little")
        self.file.seek(end - 8 - size)
        rows = [x.rsplit("\t", 2) for x in gzip.decompress(self.file.read(size)).decode().split("\n")]
        self.first = [x[0] for x in rows]
        self.places = [(int(x[1]), int(x[2])) for x in rows]
        self.held: tuple[int, list[list[str]]] | None = None

    def block(self, k: int) -> list[list[str]]:
        """Lines of the k-th block, split; the last one read is kept, as look-ups come sorted."""
        if self.held is None or self.held[0] != k:
            self.file.seek(self.places[k][0])
            self.held = k, [x.split("\t") for x in gzip.decompress(self.file.read(self.places[k][1])).decode().split("\n")]
        return self.held[1]

    def find(self, key: str) -> Iterator[tuple[int | None, str, int, int]]:
        """(page_id, path, offset, size) of all captures with the key."""
        k = max(0, bisect.bisect_left(self.first, key) - 1)  # a key may begin at the end of the block before
        while k < len(self.first) and self.first[k] <= key:
            lines = self.block(k)
            for x in lines[bisect.bisect_left(lines, key, key=lambda line: line[0]) :]:
                if x[0] != key:
                    break
                yield int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])
            k += 1


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures by key and write the index; returns the durable list of files: path, first, last, lines."""
    schema = "path string, first string, last string, lines long"
    out = common.pa_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = common.filesystem(folder)
        stream = None
        directory: list[str] = []
        block: list[str] = []
        place = count = 0
        first = last = name = ""

        def flush() -> None:
            nonlocal place, block
            raw = gzip.compress("\n".join(block).encode(), 6, mtime=0)
            stream.write(raw)
            directory.append(f"{block[0].split(chr(9), 1)[0]}\t{place}\t{len(raw)}")
            place += len(raw)
            block = []

        for batch in batches:
            for row in zip(*(batch[x].to_pylist() for x in ("key", "page_id", "path", "offset", "size"))):
                line = _line(*row)
                last = line.split("\t", 1)[0]
                if stream is None:
                    system.create_dir(at, recursive=True)
                    name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
                    stream, first = system.open_output_stream(f"{at}/{name}"), last
                block.append(line)
                count += 1
                if len(block) == BLOCK_LINES:
                    flush()
        if stream is not None:
            if block:
                flush()
            raw = gzip.compress("\n".join(directory).encode(), 6, mtime=0)
            stream.write(raw + len(raw).to_bytes(8, "little"))
            stream.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first": first, "last": last, "lines": count}], schema=out)

    # page_id and place are part of the range, so that a key with a third of all captures fills many files
    order = ["key", "page_id", "path", "offset"]
    return common.durable(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, schema), "index")


def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Captures of the distinct keys of ``keys`` (column key): key, page_id, path, offset, size.

    The list of index files (a row per file, hundreds of thousands of captures each) is small enough
    to be sent to each task.
    """
    files = sorted((r["first"], r["last"], r["path"]) for r in index.select("first", "last", "path").collect())
    schema = "key string, page_id long, path string, offset long, size long"
    out = common.pa_schema(schema)
    firsts, lasts = [x[0] for x in files], [x[1] for x in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[str, str]] = []
            for key in batch["key"].to_pylist():
                k = bisect.bisect_left(lasts, key)
                while k < len(files) and firsts[k] <= key:
                    made.append((key, files[k][2]))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.string()) for i in (0, 1)], names=["key", "index"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for key, own in zip(batch["key"].to_pylist(), batch["index"].to_pylist()):
                if own != path:
                    path, file = own, IndexFile(own)
                rows += [(key, *x) for x in file.find(key)]
                if len(rows) >= 20_000:
                    yield _columns(rows, out)
                    rows = []
            yield _columns(rows, out)

    wanted = keys.select(F.col("key")).where("key is not null").distinct().mapInArrow(route, "key string, index string")
    return wanted.repartition("index").sortWithinPartitions("index", "key").mapInArrow(find, schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read records by range, in the order of their files.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url and, if asked for,
    the payload (null for a revisit).  A response's digest and length are checked against its body.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    out = common.pa_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in common.slices(batches, 256):
            rows = []
            for own, offset, size in zip(batch["path"].to_pylist(), batch["offset"].to_pylist(), batch["size"].to_pylist()):
                if own != path:
                    system, at = common.filesystem(own)
                    path, file = own, io.BufferedReader(_Raw(system.open_input_file(at)), 1 << 20)
                file.seek(offset)
                headers, body = parse_record(zlib.decompress(file.read(size), 31))
                digest, length = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(), int(headers["X-Payload-Length"])
                kind = headers["WARC-Type"]
                if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != length):
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                refers = _page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                row = (_page_of(headers["WARC-Record-ID"]), length, digest, kind, refers, headers["WARC-Target-URI"])
                rows.append((*row, body if kind == "response" else None) if with_payload else row)
            yield _columns(rows, out)

    return captures.repartition("path").sortWithinPartitions("path", "offset").mapInArrow(read, schema)


class _Raw(io.RawIOBase):
    """An Arrow input file as Python's buffered reader wants it."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        self.file.seek(at, whence)
        return self.file.tell()

    def tell(self):
        return self.file.tell()

    def readinto(self, buffer):
        raw = self.file.read(len(buffer))
        buffer[: len(raw)] = raw
        return len(raw)


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write archives and index to the shared folder: (captures, index files)."""
    folder = common.shared_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    return captures, write_index(captures, f"{folder}/index")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, look every capture up by its key, and read the records back."""
    captures, index = archive(pages)
    return read_records(look_up(captures, index))
