"""Vector bin packing of tokenized examples into training sequences.

An example is a vector of (tokens, segments, loss-bearing tokens) and a sequence
a bin with a limit in each.  The next example of a sequence is the one, among
those that fit, whose vector has the largest dot product with what the sequence
has left, all as fractions of the limits.  Where none fits, the example with the
largest dot product is cut to what the three limits leave.  Each task packs its
rows in windows and carries what doesn't fill a sequence into the next window; its
last tokens go to sequences whose lengths are powers of two, which need no padding.
No row of documents moves between tasks.

Of a document (``pack``) each piece is one segment, and all tokens but the end id
bear loss.  Of a conversation (``pack_conversations``) each turn is a segment, and
the assistant's turns bear loss.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import coalesce, col, lit

from watchfold.llm import words

#: Examples that a window holds.
WINDOW = 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


@dataclass
class Example:
    """Ids still to place, from ``start`` of the example on; which bear loss; the segment of each, None where all are one."""

    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray
    turn: np.ndarray | None
    whole: int

    def load(self, a: int, b: int) -> tuple[int, int, int]:
        """The vector of ids a to b."""
        segments = 1 if self.turn is None or a == b else int(self.turn[b - 1] - self.turn[a]) + 1
        return b - a, segments, int(np.count_nonzero(self.loss[a:b]))

    def most(self, a: int, room: int, segments: int, loss: int) -> int:
        """How many ids from a on fit into what is left."""
        n = min(room, len(self.ids) - a)
        if np.count_nonzero(self.loss[a:a + n]) > loss:
            n = int(np.searchsorted(np.cumsum(self.loss[a:a + n]), loss, "right"))
        if self.turn is not None:
            n = int(np.searchsorted(self.turn[a:a + n], self.turn[a] + segments))
        return n


class Packer:
    """Takes examples, gives (example, from, to, sequence, offset) for each piece; from and to count in the example's held ids."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.pool: list[Example] = []
        self.held = 0

    def add(self, key, ids: np.ndarray, loss: np.ndarray, turn: np.ndarray | None = None, start: int = 0, whole: int | None = None):
        example, at, limits = Example(key, start, ids, loss, turn, len(ids) if whole is None else whole), 0, self.limits
        if turn is None:
            while len(ids) - at >= limits.tokens and np.count_nonzero(loss[at:at + limits.tokens]) <= limits.loss:
                yield example, at, at + limits.tokens, self.sequence, 0  # fills a sequence alone
                self.sequence += 1
                at += limits.tokens
        if at < len(ids):
            self.pool.append(_rest(example, at))
            self.held += len(ids) - at
        if len(self.pool) >= WINDOW and self.held >= limits.tokens or self.held >= WINDOW * limits.tokens:
            yield from self._fill(lambda total: limits.tokens if total >= limits.tokens else 0)

    def end(self):
        """Pack what is left, at last in lengths that are powers of two."""
        yield from self._fill(lambda total: min(self.limits.tokens, 1 << max(total, 1).bit_length() - 1) if total else 0)

    def _fill(self, length_for):
        """Fill sequences of the lengths that ``length_for(tokens in the pool)`` asks for, until it gives 0."""
        pool, limits = self.pool, self.limits
        tokens, segments, loss = np.array([x.load(0, len(x.ids)) for x in pool], np.int64).reshape(-1, 3).T.copy()
        start = np.zeros(len(pool), np.int64)
        total = int(tokens.sum())
        while (length := length_for(total)) > 0:
            room, left, room_loss, offset = length, limits.segments, limits.loss, 0
            shut = tokens == 0  # placed, or without an id that fits here
            while room and left:
                worth = tokens * (room / limits.tokens**2) + segments * (left / limits.segments**2) + loss * (room_loss / limits.loss**2)
                fits = ~shut & (tokens <= room) & (segments <= left) & (loss <= room_loss)
                if fits.any():
                    i = int(np.where(fits, worth, -1.0).argmax())
                    take = int(tokens[i])
                else:
                    i = int(np.where(shut, -1.0, worth).argmax())
                    if shut[i]:
                        break
                    take = pool[i].most(int(start[i]), room, left, room_loss)
                    if not take:
                        shut[i] = True
                        continue
                x, a = pool[i], int(start[i])
                yield x, a, a + take, self.sequence, offset
                used = x.load(a, a + take)
                start[i] = a = a + take
                tokens[i], segments[i], loss[i] = x.load(a, len(x.ids))
                shut[i] = True  # a cut example goes on in another sequence
                room, left, room_loss, offset, total = room - take, left - used[1], room_loss - used[2], offset + take, total - take
            self.sequence += 1
        self.pool = [_rest(x, int(a)) for x, a, t in zip(pool, start, tokens) if t]
        self.held = total


def _rest(x: Example, at: int) -> Example:
    """What is left of an example; copied, so that a short rest doesn't hold a long text's ids."""
    if not at:
        return x
    return Example(x.key, x.start + at, x.ids[at:].copy(), x.loss[at:].copy(), None if x.turn is None else x.turn[at:].copy(), x.whole)


def _batch(out: list[tuple], kind, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*out))
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]], names)


def pack(examples: DataFrame, path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id",
         text_col: str = "text", bears_loss: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``bears_loss`` tells the rows whose tokens bear loss, their end id aside;
    without it all do.  Nulls: a null text is empty (only its end id), a null id is
    kept, a null ``bears_loss`` is false.  Repeated rows are packed each.  Empty
    table: empty result.  Other columns are ignored, whatever their names.
    """

    def run(batches):
        tokenizer = words.load(path)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], tokenizer.dtype)
        out: list[tuple] = []

        def rows(pieces):
            for x, a, b, sequence, offset in pieces:
                crc = zlib.crc32(x.ids[a:b].astype("<u4").tobytes())
                out.append((x.key, x.start + a, b - a, crc, x.whole, sequence, offset, x.load(a, b)[2]))

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            for key, ids, loss in zip(b.column(0).to_pylist(), tokenizer.encode(b.column(1).to_pylist()), b.column(2).to_pylist()):
                ids = np.concatenate([ids, end])
                mask = np.full(len(ids), loss)
                mask[-1] = False
                rows(packer.add(key, ids, mask))
            if out:
                yield _batch(out, kind, names)
        rows(packer.end())
        if out:
            yield _batch(out, kind, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    kind = examples.schema[id_col].dataType.simpleString()
    loss = lit(True) if bears_loss is None else coalesce(bears_loss, lit(False))
    chosen = examples.select(col(id_col).alias("doc_id"), coalesce(col(text_col), lit("")).alias("text"), loss.alias("loss"))
    return chosen.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


#: Turns of a conversation that are held before they go to the packer; a longer one goes there in parts.
TURNS = 4096


def pack_conversations(turns: DataFrame, path: str, end_id: int, limits: Limits = Limits(), role: str = "assistant") -> DataFrame:
    """One row per piece: conv_id, start, length, ids_crc32, segments, loss_tokens, sequence_id, offset.

    ``turns``: conv_id, turn, role, text.  A conversation is an example: its turns
    in order, ``end_id`` after each; turns of ``role`` bear loss.  Its turns are
    brought together by a shuffle and sorted, and stream to the packer: no
    conversation is held beyond TURNS turns.  Nulls: a null text is empty, a null
    role bears no loss, turns without conv_id are one conversation.  Turns that
    repeat a number go by their text.  Empty table: empty result.
    """

    def run(batches):
        tokenizer, packer, none = words.load(path), Packer(limits, TaskContext.get().partitionId() << 40), object()
        out, key, start, held = [], none, 0, []

        def rows(pieces):
            for x, a, b, sequence, offset in pieces:
                _, segments, loss = x.load(a, b)
                out.append((x.key, x.start + a, b - a, zlib.crc32(x.ids[a:b].astype("<u4").tobytes()), segments, loss, sequence, offset))

        def hand_over():
            nonlocal start
            if held:
                size = [len(ids) for ids, _ in held]
                rows(packer.add(key, np.concatenate([ids for ids, _ in held]), np.repeat([bears for _, bears in held], size), np.repeat(np.arange(len(held)), size), start))
                start += sum(size)
                held.clear()

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            for own, bears, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), tokenizer.encode(b.column(2).to_pylist())):
                if own != key or key is none:
                    hand_over()
                    key, start = own, 0
                held.append((np.append(ids, tokenizer.dtype.type(end_id)), bears))
                if len(held) == TURNS:
                    hand_over()
            if out:
                yield _batch(out, kind, names)
        hand_over()
        rows(packer.end())
        if out:
            yield _batch(out, kind, names)

    names = ["conv_id", "start", "length", "ids_crc32", "segments", "loss_tokens", "sequence_id", "offset"]
    kind = turns.schema["conv_id"].dataType.simpleString()
    text = coalesce(col("text"), lit(""))
    ordered = turns.select("conv_id", "turn", coalesce(col("role") == role, lit(False)).alias("bears"), text.alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").select("conv_id", "bears", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
