"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own.  Of equal payloads
one record is a response and the others are revisits that refer to it.

The index sorts captures by their reversed-host key (``com,example,www)/path``)
into parts.  A part holds compressed blocks of index lines and, at its end, a
sparse directory of each block's first key and place.  A search goes by binary
search from the table of parts to a part's directory, to a line of one block,
and only then reads the record's range of its archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import coalesce, col, lit

from watchfold.llm import files
from watchfold.shared import Scratch

#: Bytes after which a task begins another archive file.
ARCHIVE_BYTES = 256_000_000
#: Index lines of a block, captures that a part is planned to hold, and the most parts: beyond that parts grow,
#: by blocks, while the table of parts that is sent around stays as it is.
BLOCK_LINES = 256
PART_CAPTURES = 4096
PARTS = 4096
#: Captures of a part that are read at a time, in the order in which the archives hold them.
READ = 16_384
#: Archive files that a reader keeps open.
OPEN_FILES = 64
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_TAIL = "<QQ"
_CAPTURE = "page_id long, key string, uri string, at long, size long"


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL; empty for none."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    end = min((at for mark in "/?#" if (at := rest.find(mark)) >= 0), default=len(rest))
    host, path = rest[:end].rpartition("@")[2].partition(":")[0].lower(), rest[end:]
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def _page_id(urn: str | None):
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "None") else None


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int

    @property
    def page_id(self):
        return _page_id(self.headers["WARC-Record-ID"])

    @property
    def record_type(self) -> str:
        return self.headers["WARC-Type"]

    @property
    def digest(self) -> str:
        return self.headers["WARC-Payload-Digest"].partition(":")[2]

    @property
    def refers_to(self):
        return _page_id(self.headers.get("WARC-Refers-To"))


def parse_record(member: bytes) -> Record:
    """One gzip member's record; raises ValueError where lengths or the payload's digest differ."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(headers["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    record = Record(headers, payload, size)
    if record.record_type == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != record.digest):
        raise ValueError(f"record {headers['WARC-Record-ID']}: its payload differs from its length or digest")
    return record


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Files:
    """Archive files by URI, the last used ones kept open."""

    def __init__(self):
        self.open: OrderedDict = OrderedDict()

    def read(self, uri: str, at: int, size: int) -> bytes:
        f = self.open.pop(uri, None) or files.open_random(uri)
        self.open[uri] = f
        if len(self.open) > OPEN_FILES:
            self.open.popitem(last=False)[1].close()
        f.seek(at)
        return f.read(size)

    def size(self, uri: str) -> int:
        f = self.open.pop(uri, None) or files.open_random(uri)
        self.open[uri] = f
        return f.size()

    def close(self):
        for f in self.open.values():
            f.close()


def _directory(store: _Files, uri: str) -> list:
    """A part's directory: [first key, offset, size] of each block."""
    end = store.size(uri)
    at, size = struct.unpack(_TAIL, store.read(uri, end - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
    return json.loads(zlib.decompress(store.read(uri, at, size)))


def _block(store: _Files, uri: str, at: int, size: int) -> list:
    """A block's lines: [key, page_id, archive, offset, size], sorted by key."""
    return json.loads(zlib.decompress(store.read(uri, at, size)))


@dataclass(frozen=True)
class Archive:
    """The table of an archive's index parts, in order: (first key, last key, uri)."""

    parts: list[tuple[str, str, str]]

    def lookup(self, url: str, store: _Files | None = None) -> Iterator[Record]:
        """All captures of a URL, by binary search in each level before any record is read."""
        store, key = store or _Files(), url_key(url)
        first = bisect.bisect_left(self.parts, key, key=lambda p: p[1])
        for low, _, uri in self.parts[first:]:
            if low > key:
                return
            blocks = _directory(store, uri)
            # A key's captures may begin in the block before the first one that starts with it.
            for start, at, size in blocks[max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1):]:
                if start > key:
                    return
                lines = _block(store, uri, at, size)
                for k, _, archive, offset, length in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]):]:
                    if k != key:
                        break
                    yield parse_record(store.read(archive, offset, length))


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          least_bytes: int = 0) -> Archive:
    """Write all pages as WARC records and index them.

    Payloads under ``least_bytes`` are all responses.  Of equal payloads, rows
    that tie on the largest id are all responses; a null id sorts below others.
    """
    spark = pages.sparkSession
    payload = F.encode(coalesce(col(html_col), lit("")), "UTF-8")
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    copies = rows.where(F.length("payload") >= least_bytes).groupBy("digest", F.length("payload").alias("bytes")).agg(
        F.max("page_id").alias("response"), F.count(lit(1)).alias("n")).where("n > 1").select("digest", "bytes", "response")
    # Written, so that the join's exchanges stand alone and its hot partitions can be split.
    copies = scratch.write("copies", copies)
    joined = rows.withColumn("bytes", F.length("payload")).join(
        copies.withColumn("copied", lit(True)).hint("merge"), ["digest", "bytes"], "left")
    revisit = coalesce(col("copied") & ~col("page_id").eqNullSafe(col("response")), lit(False))
    ready = joined.select("page_id", "url", "payload", "digest", "response", revisit.alias("revisit"))
    folder = f"{scratch.path}/archive"

    def archive(batches):
        out = uri = None
        for b in batches:
            lines, at = [], out.tell() if out else 0
            for page_id, url, body, digest, response, again in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    out, at = files.create(uri := files.new_name(folder, ".warc.gz")), 0
                member = _record(page_id, url, body, _base32(digest), response, again)
                out.write(member)
                lines.append((page_id, url_key(url), uri, at, len(member)))
                at += len(member)
            if lines:
                page, key, name, offset, size = zip(*lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(key, pa.string()), pa.array(name, pa.string()),
                     pa.array(offset, pa.int64()), pa.array(size, pa.int64())], ["page_id", "key", "uri", "at", "size"])
        if out:
            out.close()

    captures = scratch.write("captures", ready.mapInArrow(archive, _CAPTURE))
    return Archive(_write_index(captures, f"{scratch.path}/index"))


def _write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Sort captures into parts of compressed blocks; one row per part, PARTS at most, reaches the driver."""

    def parts(batches):
        out, held, directory, at, last = None, [], [], 0, ""
        uri = files.new_name(folder, ".idx")

        def block(lines):
            nonlocal at
            raw = zlib.compress(json.dumps(lines).encode(), 6)
            out.write(raw)
            directory.append([lines[0][0], at, len(raw)])
            at += len(raw)

        for b in batches:
            out = out or files.create(uri)
            held += map(list, zip(*(b.column(n).to_pylist() for n in ("key", "page_id", "uri", "at", "size"))))
            while len(held) >= BLOCK_LINES:
                block(held[:BLOCK_LINES])
                last, held = held[BLOCK_LINES - 1][0], held[BLOCK_LINES:]
        if out is None:
            return
        if held:
            last = held[-1][0]
            block(held)
        raw = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(raw + struct.pack(_TAIL, at, len(raw)))
        out.close()
        yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "last": last, "uri": uri}])

    n = min(PARTS, max(1, captures.count() // PART_CAPTURES))
    order = ["key", "page_id", "uri", "at"]
    dealt = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(parts, "first string, last string, uri string").collect()
    # Keys are compared by code point here and by UTF-8 bytes in Spark; both give one order.
    return sorted((r["first"], r["last"], r["uri"]) for r in written)


def _facts(r) -> tuple:
    return r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """All captures, through the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def load(batches):
        for b in batches:
            for uri in b.column(1).to_pylist():
                store = _Files()
                blocks, step = _directory(store, uri), max(1, READ // BLOCK_LINES)
                for k in range(0, len(blocks), step):
                    ranges = sorted(tuple(line[2:]) for _, at, size in blocks[k:k + step] for line in _block(store, uri, at, size))
                    got = [_facts(parse_record(store.read(*r))) for r in ranges]  # a payload is dropped once it is checked
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*got), kinds)], names)
                store.close()

    rows = [(i, p[2]) for i, p in enumerate(archive.parts)]
    parts = spark.createDataFrame(rows, "part int, uri string").repartitionById(max(1, len(rows)), col("part"))
    return parts.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(urls: DataFrame, archive: Archive, url_col: str = "url") -> DataFrame:
    """(url, page_id, record_type, payload) of every capture of every URL, found in the tasks that hold the URLs."""

    def find(batches):
        store = _Files()
        for b in batches:
            got = [(u, r.page_id, r.record_type, r.payload) for u in b.column(0).to_pylist() if u for r in archive.lookup(u, store)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.binary())],
                ["url", "page_id", "record_type", "payload"])
        store.close()

    return urls.select(col(url_col).alias("url")).mapInArrow(find, "url string, page_id long, record_type string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives in the shared folder, and read every record back through the index.

    One row per input row.  Nulls: null html is empty; a null URL has the empty
    key and no target header; a null id is kept.  Repeated rows are written each.
    Empty table: empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, scratch, id_col, url_col, html_col, least_bytes))
