"""Tables of encoded pieces: what splitting and encoding share, whatever the vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Pieces that a table holds before it starts anew; bounds a worker's memory, never the result.
PIECES = 500_000
LATIN_PIECES = 400_000
#: Characters of text that are split and encoded at a time.
CHARS = 2_000_000


class _Numbers(dict):
    """Piece -> number; a piece not met before gets the next one and is noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def ragged(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] for every i, joined."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - ends + count, count) + np.arange(total)]


class PieceTable:
    """Encodes each distinct piece once, by ``encode(pieces) -> (ids, counts)``."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.int32):
        self.encode, self.dtype = encode, dtype
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start = self.count = np.zeros(0, np.int64)

    def lookup(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        if len(self.numbers) > PIECES:
            self.clear()
        at = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if new := self.numbers.new:
            ids, count = self.encode(new)
            self.numbers.new = []
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used:self.used + len(ids)] = ids
            self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.used += len(ids)
        count = self.count[at]
        return ragged(self.ids, self.start[at], count), count


def in_blocks(texts: Iterable[str]):
    """Lists of whole texts of about CHARS characters each."""
    block, chars = [], 0
    for text in texts:
        block.append(text)
        chars += len(text)
        if chars >= CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


class WordTable:
    """A number for every word of bytes, found for whole arrays of words.

    Words of up to 15 bytes are told apart by those bytes and their length, two
    64-bit keys, which an open-addressing table compares whole; longer ones are
    keys of a dict.  ``new`` gives the numbers of words that weren't met before,
    any but ``UNKNOWN``.
    """

    UNKNOWN = np.iinfo(np.int32).min
    #: Bytes that must follow the last word of an array.
    PAD = 15

    def __init__(self, new: Callable[[list[bytes]], np.ndarray]):
        self.new = new
        # Of a word of n bytes, which bits of its first and of its second 64 count; the length is on top of the second.
        n, full = np.arange(16), np.uint64(0xFFFFFFFFFFFFFFFF)
        some = lambda k: np.where(k > 0, full >> (64 - 8 * np.maximum(k, 1)).astype(np.uint64), 0).astype(np.uint64)
        self.mask = some(np.minimum(n, 8)), some(np.clip(n - 8, 0, 7))
        self.clear()

    def clear(self) -> None:
        self.bits, self.n = 16, 0
        self._empty()
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.n + len(self.long)

    def _empty(self) -> None:
        self.keys = np.zeros((1 << self.bits, 2), np.uint64)
        self.number = np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words, UNKNOWN for those that are not in the table."""
        slot = self._slots(keys)
        there = self.keys.take(slot, axis=0)
        same = (there[:, 0] == keys[:, 0]) & (there[:, 1] == keys[:, 1])
        out = np.where(same, self.number.take(slot), np.int32(self.UNKNOWN))
        rest = np.flatnonzero(~same & (there[:, 1] != 0))
        while len(rest):
            slot[rest] = at = (slot[rest] + 1) & (1 << self.bits) - 1
            there = self.keys.take(at, axis=0)
            same = (there == keys[rest]).all(axis=1)
            out[rest[same]] = self.number[at[same]]
            rest = rest[~same & (there[:, 1] != 0)]
        return out

    def _insert(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Put distinct new keys in the table, which has room for them."""
        slot, rest = self._slots(keys), np.arange(len(keys))
        owner = np.full(1 << self.bits, -1, np.int32)
        while len(rest):
            free = self.keys[slot[rest], 1] == 0
            owner[slot[rest[free]]] = rest[free]
            won = free & (owner[slot[rest]] == rest)
            own = rest[won]
            self.keys[slot[own]], self.number[slot[own]] = keys[own], number[own]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & (1 << self.bits) - 1

    def _add(self, keys: np.ndarray, number: np.ndarray) -> None:
        if 2 * (self.n + len(keys)) > len(self.number):  # half of the table stays free
            old = np.flatnonzero(self.keys[:, 1])
            old_keys, old_number = self.keys[old], self.number[old]
            while 2 * (self.n + len(keys)) > 1 << self.bits:
                self.bits += 1
            self._empty()
            self._insert(old_keys, old_number)
        self._insert(keys, number)
        self.n += len(keys)

    def add(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> None:
        """Distinct words raw[start:end] that weren't met before, and their numbers; PAD bytes follow the last."""
        length = end - start
        short = length <= 15
        self._add(self._keys(raw, start, length)[short], number[short])
        for i in np.flatnonzero(~short).tolist():
            self.long[raw[start[i]:end[i]].tobytes()] = int(number[i])

    def _keys(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = np.minimum(length, 15)
        # The 64 bits that start at each byte; a buffer may be read at any byte.
        words = np.ndarray(len(raw) - 15, "<u8", raw, strides=(1,)), np.ndarray(len(raw) - 15, "<u8", raw, 8, strides=(1,))
        keys = np.empty((len(start), 2), np.uint64)
        for i in range(2):
            np.bitwise_and(words[i].take(start), self.mask[i].take(short), out=keys[:, i])
        keys[:, 1] |= short.astype(np.uint64) << np.uint64(56)
        return keys

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words raw[start:end], UNKNOWN for those not met before; PAD bytes follow the last."""
        length = end - start
        number = self._find(self._keys(raw, start, length))
        for i in np.flatnonzero(length > 15).tolist():
            number[i] = self.long.get(raw[start[i]:end[i]].tobytes(), self.UNKNOWN)
        return number

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words raw[start:end]; PAD bytes follow the last."""
        length = end - start
        keys = self._keys(raw, start, length)
        number = self._find(keys)
        over = np.flatnonzero(length > 15)
        if len(over):
            lowered = raw.tobytes()
            own = [lowered[a:b] for a, b in zip(start[over].tolist(), end[over].tolist())]
            if new := list(dict.fromkeys(p for p in own if p not in self.long)):
                self.long |= zip(new, self.new(new).tolist())
            number[over] = [self.long[p] for p in own]
        missing = np.flatnonzero(number == self.UNKNOWN)
        if len(missing):
            one, inverse = np.unique(keys[missing].view("V16").ravel(), return_index=True, return_inverse=True)[1:]
            lowered, at = raw.tobytes(), missing[one]
            new = self.new([lowered[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            self._add(keys[at], new)
            number[missing] = new[inverse.ravel()]
        return number


class LatinPieces:
    """Splits texts of bytes into runs of letters, single numerals and runs of other signs, and knows the pieces again.

    An apostrophe that starts a run of other signs takes the ending of a
    contraction with it.
    """

    SPACE, LETTER, NUMERAL, OTHER = range(4)
    #: Endings of contractions; fixed values of the splitting pattern.
    ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, kind_of: Callable[[str], int], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, most: int = LATIN_PIECES):
        """kind_of: of each character up to U+00FF, one of the four kinds."""
        self.encode, self.dtype, self.most = encode, dtype, most
        self.kind = np.array([kind_of(chr(c)) for c in range(256)], np.uint8)
        self.lower = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)
        self.one = np.zeros(256, bool)
        self.one[[ord(e) for e in self.ENDINGS if len(e) == 1]] = True
        self.two = np.array([ord(e[0]) << 8 | ord(e[1]) for e in self.ENDINGS if len(e) == 2])
        self.table = WordTable(self._add)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start = self.count = np.zeros(0, np.int64)

    def split(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; ``raw`` is lower-cased and ends in white space."""
        kind = self.kind.take(raw)
        changed = np.empty(len(kind), bool)
        changed[0] = True
        np.not_equal(kind[1:], kind[:-1], out=changed[1:])
        # Apostrophes that start a run of other signs and stand before a letter.
        quote = np.flatnonzero((raw == 39) & changed)
        quote = quote[kind[quote + 1] == self.LETTER]
        if len(quote):
            wide = np.r_[raw, np.zeros(2, np.uint8)]
            a, b = wide[quote + 1], wide[quote + 2]
            size = np.where(self.one[a], 1, np.where(np.isin(a.astype(np.int64) << 8 | b, self.two), 2, 0))
            quote, size = quote[size > 0], size[size > 0]
        changed |= kind == self.NUMERAL
        changed[quote + 1] = False
        if len(quote):
            changed[quote + 1 + size] = True
        edges = np.flatnonzero(changed)
        piece = np.flatnonzero(kind[edges] != self.SPACE)
        return edges[piece], np.append(edges, len(raw))[piece + 1]

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces; their numbers."""
        ids, count = self.encode([p.decode("latin-1") for p in pieces])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        first = len(self.count)
        self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(ids)
        return np.arange(first, first + len(pieces), dtype=np.int32)

    def lookup(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if len(self.count) > self.most:
            self.clear()
        raw = self.lower.take(np.frombuffer(b"\n".join(texts) + b"\n" + bytes(WordTable.PAD), np.uint8))
        start, end = self.split(raw[:-WordTable.PAD])
        number = self.table(raw, start, end)
        count = self.count.take(number)
        ids = ragged(self.ids, self.start.take(number), count)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.searchsorted(start, np.cumsum(size + 1))
        total = np.r_[0, np.cumsum(count)][np.r_[0, ends]]
        return ids, np.diff(total)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def space_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words between ASCII white space, A-Z lower-cased: the bytes of all texts, starts and ends in them, words of each text."""
    raw = _LOWER.take(np.frombuffer(b"\n".join(texts) + b"\n" + bytes(WordTable.PAD), np.uint8))
    space = _SPACE.take(raw[:-WordTable.PAD])
    before = np.r_[True, space[:-1]]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return raw, start, end, np.diff(np.r_[0, np.searchsorted(start, np.cumsum(size + 1))])
