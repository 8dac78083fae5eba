"""Token ids of a corpus in compressed binary files, in ascending document order.

A file holds the ids of a run of documents:

    magic "WFTOK1\\n\\0", then groups, then the document table, then a tail
    group: u32 bytes of the order-0 table, that table, u32 ids, u32 blocks, and
           for each block u32 bytes, u32 crc32 of its ids; then the payloads
    table: zlib of i64 document ids, u8 flags (1: id is null), u32 token counts
    tail:  u64 offset of the table, u64 documents, u64 ids, u32 crc32 of the table

Groups are coded by ``mixing``: each block resets all adaptive state and carries
its own checksum, which every read compares.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import coalesce, col, lit

from watchfold.llm import files, mixing, words
from watchfold.shared import Scratch

MAGIC = b"WFTOK1\n\0"
GROUP = mixing.BLOCK * mixing.LANES
#: Characters of text that a file is planned to hold, and the most files.
FILE_CHARS = 20_000_000
FILES = 1 << 16
_TAIL = "<QQQI"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _write_group(out, ids: np.ndarray) -> None:
    freq = mixing.Frequencies.count(ids)
    header = freq.to_bytes()
    payloads = mixing.encode(ids, freq)
    out.write(struct.pack("<I", len(header)) + header + struct.pack("<II", len(ids), len(payloads)))
    heads = [(len(p), _crc(ids[i * mixing.BLOCK:(i + 1) * mixing.BLOCK])) for i, p in enumerate(payloads)]
    out.write(np.array(heads, "<u4").tobytes())
    out.write(b"".join(payloads))


def _read_groups(f, end: int):
    """The ids of every group up to offset ``end``; raises ValueError where a checksum differs."""
    while f.tell() < end:
        (size,) = struct.unpack("<I", f.read(4))
        freq = mixing.Frequencies.from_bytes(f.read(size))
        n, blocks = struct.unpack("<II", f.read(8))
        heads = np.frombuffer(f.read(8 * blocks), "<u4").reshape(-1, 2)
        raw = f.read(int(heads[:, 0].sum(dtype=np.int64)))
        cut = np.r_[0, np.cumsum(heads[:, 0], dtype=np.int64)]
        ids = mixing.decode([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], n, freq)
        for i, crc in enumerate(heads[:, 1].tolist()):
            if _crc(ids[i * mixing.BLOCK:(i + 1) * mixing.BLOCK]) != crc:
                raise ValueError(f"block {i} of a group: its checksum differs")
        yield ids


def _files(docs: DataFrame) -> int:
    """Files of about FILE_CHARS characters each, FILES at most; beyond that files grow."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(FILES, max(1, -(-chars // FILE_CHARS)))


class _Writer:
    """One file: the ids and the document table of the rows that a task is given."""

    def __init__(self, folder: str):
        self.uri = files.new_name(folder, ".wftok")
        self.out = files.create(self.uri)
        self.out.write(MAGIC)
        self.keys, self.counts, self.held, self.n_held, self.ids = [], [], [], 0, 0

    def add(self, keys: list, ids: list[np.ndarray]) -> None:
        self.keys += keys
        for own in ids:
            self.counts.append(len(own))
            self.held.append(own)
            self.n_held += len(own)
            # Two groups are held, so that the last ones can share what is left.
            if self.n_held >= 2 * GROUP:
                self._groups(GROUP, self.n_held - GROUP)

    def _groups(self, size: int, until: int) -> None:
        """Write groups of ``size`` ids until at most ``until`` ids are held."""
        ids, at = np.concatenate(self.held), 0
        while len(ids) - at > until:
            _write_group(self.out, ids[at:at + size])
            at += size
        self.ids += min(at, len(ids))
        self.held = [ids[at:]]
        self.n_held = len(self.held[0])

    def close(self) -> tuple:
        if self.n_held:  # one group, or two halves
            half = -(-self.n_held // 2 // mixing.BLOCK) * mixing.BLOCK
            self._groups(self.n_held if self.n_held <= 1.25 * GROUP else half, 0)
        null = np.array([k is None for k in self.keys], np.uint8)
        table = zlib.compress(np.array([k or 0 for k in self.keys], "<i8").tobytes() + null.tobytes() + np.array(self.counts, "<u4").tobytes(), 1)
        at = self.out.tell()
        self.out.write(table + struct.pack(_TAIL, at, len(self.keys), self.ids, zlib.crc32(table)))
        self.out.close()
        return self.uri, len(self.keys), self.ids


def write(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Write the ids of every whole text, ``end_id`` after each; the files in order as (uri, documents, ids).

    Ties of the document id are ordered by a hash of the text; null ids come first.
    Files are ranges of (id, hash, row), so rows that repeat an id may share out over files.
    """

    def store(batches):
        tokenizer, writer = words.load(path), None
        end = np.array([end_id], tokenizer.dtype)
        for b in batches:
            writer = writer or _Writer(folder)
            writer.add(b.column(0).to_pylist(), [np.concatenate([x, end]) for x in tokenizer.encode(b.column(1).to_pylist())])
        if writer:
            uri, documents, ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "uri": uri, "documents": documents, "ids": ids}], schema=pa.schema(
                [("part", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    texts = docs.select(col(id_col).alias("doc_id"), coalesce(col(text_col), lit("")).alias("text"))
    keys = ["doc_id", "hash", "row"]
    keyed = texts.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(_files(texts), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    # One row per file reaches the driver, FILES rows at most.
    written = ordered.mapInArrow(store, "part int, uri string, documents long, ids long").collect()
    return [(r.uri, r.documents, r.ids) for r in sorted(written, key=lambda r: r.part)]


def read(spark: SparkSession, written: list[tuple], kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, start counted over all of them."""
    base, rows = 0, []
    for uri, _, ids in written:
        rows.append((len(rows), uri, base))
        base += ids

    def load(batches):
        for b in batches:
            for uri, start in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                with files.open_random(uri) as f:
                    size = f.size()
                    f.seek(size - struct.calcsize(_TAIL))
                    at, documents, _, crc = struct.unpack(_TAIL, f.read(struct.calcsize(_TAIL)))
                    f.seek(at)
                    table = f.read(size - struct.calcsize(_TAIL) - at)
                    if zlib.crc32(table) != crc:
                        raise ValueError(f"{uri}: the checksum of its document table differs")
                    table = zlib.decompress(table)
                    keys, null, counts = (np.frombuffer(table, t, documents, o * documents) for t, o in (("<i8", 0), ("u1", 8), ("<u4", 9)))
                    f.seek(0)
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{uri} is no token file")
                    ends = np.cumsum(counts, dtype=np.int64)
                    crcs, rest, done, doc = [], np.zeros(0, "<u4"), 0, 0
                    for ids in _read_groups(f, at):
                        rest = np.concatenate([rest, ids.astype("<u4")])
                        while doc < documents and ends[doc] - done <= len(rest):
                            n = int(ends[doc] - done)
                            crcs.append(zlib.crc32(rest[:n].tobytes()))
                            rest, done, doc = rest[n:], int(ends[doc]), doc + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(start + ends - counts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.createDataFrame(rows, "part int, uri string, base long").repartitionById(max(1, len(rows)), col("part"))
    return parts.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", col("doc_id").cast(kind))


def round_trip(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Nulls: a null text is empty (only its end id), null document ids come first.
    Repeated rows are written each.  Empty table: no file, empty result.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    written = write(docs, path, end_id, scratch.path, id_col, text_col)
    return read(docs.sparkSession, written, docs.schema[id_col].dataType.simpleString())
