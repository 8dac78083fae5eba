"""Byte-level BPE encoding and decoding in padded numpy matrices.

Texts are split by the tokenizer's pattern; each distinct piece is encoded once
per worker.  Pieces of similar length form a padded matrix of token ids.  Each
round every row looks up the ranks of its changed pairs in an open-addressing
hash table, merges its leftmost pair of the least rank, and the matrix is
compacted: it loses a column, and rows without a pair to merge leave it.
Pieces longer than the widest matrix follow the same rule with a heap, so that
a run of a million letters takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import coalesce, col, lit

from watchfold.llm.pieces import PieceTable, in_blocks

#: Widths of the matrices, in bytes of a piece.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
NO_RANK = np.int32(2**31 - 1)


class PairHash:
    """(left id, right id) -> rank, in an open-addressing table probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        keys = self._key(left, right)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[slot[rest]] < 0
            claim, first = np.unique(slot[rest][free], return_index=True)
            put = rest[free][first]
            self.keys[claim], self.ranks[claim] = keys[put], rank[put]
            rest = np.setdiff1d(rest, put, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left, right):
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where they don't merge or an id is negative."""
        out = np.full(left.shape, NO_RANK, np.int32)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[rest], right[rest])
        slot = self._slot(keys)
        while len(rest):
            there = self.keys[slot]
            hit = there == keys
            out[rest[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there >= 0)
            rest, keys, slot = rest[go], keys[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out


class ByteBPE:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.tokens}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairHash(*np.array(pairs, np.int32).reshape(-1, 3).T)
        space = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split_any = regex.compile(space).findall
        self.split_latin = re.compile(_latin(pattern)).findall
        self.table = PieceTable(self.encode_pieces)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)  # the same pattern with the classes written out, for a faster engine

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece in turn, and how many each has."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for i, b in enumerate(raw):
            if (whole := self.ranks.get(b)) is not None:
                out[i] = (whole,)
            elif len(b) > WIDTHS[-1]:
                out[i] = self._by_heap(b)
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(b)), []).append(i)
        for width, rows in by_width.items():
            for at in range(0, len(rows), 50_000):
                part = rows[at:at + 50_000]
                for i, ids in zip(part, self._merge([raw[i] for i in part], width)):
                    out[i] = ids
        count = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((t for ids in out for t in ids), np.int32, int(count.sum())), count

    def _merge(self, rows: list[bytes], width: int) -> list[list[int]]:
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        row, out = np.arange(len(rows)), [None] * len(rows)
        while len(row):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), best] if rank.shape[1] else np.full(len(row), NO_RANK)
            ended = least == NO_RANK
            if ended.any():
                left = ids[ended]
                for r, line, n in zip(row[ended].tolist(), left.tolist(), (left >= 0).sum(axis=1).tolist()):
                    out[r] = line[:n]
                go = ~ended
                row, ids, rank, best, least = row[go], ids[go], rank[go], best[go], least[go]
                if not len(row):
                    break
            at = np.arange(len(row))
            ids[at, best] = least
            keep = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, keep + (keep > best[:, None]), axis=1)
            keep = keep[:-1]
            rank = np.take_along_axis(rank, keep + (keep >= best[:, None]), axis=1)
            if rank.shape[1]:
                here, before = best < rank.shape[1], best > 0
                a, b = at[here], best[here]
                rank[a, b] = self.pairs(ids[a, b], ids[a, b + 1])
                a, b = at[before], best[before] - 1
                rank[a, b] = self.pairs(ids[a, b], ids[a, b + 1])
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        """The same merges for a long piece: least rank first, leftmost of equals."""
        get, parts = self.ranks.get, [piece[i:i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ranks[p] for p in parts if p is not None]

    def encode(self, texts: list[str]):
        """Id arrays of whole texts, one for each."""
        for block in in_blocks(texts):
            pieces, ends = [], [0]
            for text in block:
                pieces += self.split(text)
                ends.append(len(pieces))
            ids, count = self.table.lookup(pieces)
            cut = np.r_[0, np.cumsum(count)][ends]
            yield from (ids[a:b] for a, b in zip(cut[:-1], cut[1:]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _latin(pattern: str) -> str:
    r"""``pattern`` with \p{L}, \p{N} and \s as the characters below U+0100 that they hold."""
    letters, numbers, space = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
    for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"[^\s", f"[^{space}"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        inside = name.startswith(r"\p")
        if inside:  # within a negated class as it is, else as a class of its own
            pattern = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(name, chars), pattern)
            pattern = pattern.replace(name, f"[{chars}]")
        else:
            pattern = pattern.replace(name, chars)
    return pattern


@cache
def load(path: str, pattern: str) -> ByteBPE:
    """The codec of a file of base64 tokens and ranks; one for each worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, an array of ints; a null text is empty."""

    def run(batches):
        codec = load(path, pattern)
        for b in batches:
            ids = [x for x in codec.encode(b.column(1).to_pylist())]
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), coalesce(col(text_col), lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of every row's ids; null ids are none."""

    def run(batches):
        codec = load(path, pattern)
        for b in batches:
            out = [codec.decode(np.array(x or (), np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each whole text is encoded, its ids decoded again, and both hashed where they
    are, so that no ids cross to the JVM.  Nulls: a null text is empty (no ids); a
    null id is kept.  Repeated rows get a row each.  Empty table: empty result.
    """

    def run(batches):
        codec = load(path, pattern)
        text, sha = codec.decimal.__getitem__, hashlib.sha256
        for b in batches:
            rows = [(len(ids), sha(" ".join(map(text, ids.tolist())).encode()).hexdigest(), sha(codec.decode(ids)).hexdigest())
                    for ids in codec.encode(b.column(1).to_pylist())]
            n, ids_sha, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), coalesce(col(text_col), lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
