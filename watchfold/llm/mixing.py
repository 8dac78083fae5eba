"""An adaptive context-mixing range coder for token ids, over many blocks at once.

A block is coded on its own: all adaptive state starts anew, so any block can be
read alone.  For each id three orders predict:

* order 2: the id last seen after a hash of the two previous ids,
* order 1: the id last seen after a hash of the previous id,
* order 0: the frequencies of ids, as 16 classes of about equal weight whose
  counts adapt within the block, and each class's ids by the frequencies in the
  header.

The probability of an id is the mixture of the three.  The weights of orders 2
and 1 (order 0 has the rest) belong to a set chosen by how often the two
predictions have just held and whether they agree; each set's weights move
towards the order that was right.

The mixture drives a range coder, one narrowing an id: the range is divided into
2**37 units, the product of 2**11 of the mixture, 2**10 of the classes and 2**16
of a class's ids.  Ranges have 46 to 62 bits; 16 bits leave at a time, and
carries are settled when a block ends.

The steps of a block depend on each other, so numpy takes the same step of all
blocks ("lanes") at a time.  Encoder and decoder share the model.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 4096
CLASSES = 16
SLOT_BITS = 9
SETS = 32
REBUILD = 32
_MIX_BITS, _CLASS_BITS, _SHARE_BITS = 11, 10, 16
_REST_BITS = _CLASS_BITS + _SHARE_BITS
_UNITS = np.uint64(_MIX_BITS + _REST_BITS)
_LAST = (1 << _MIX_BITS + _REST_BITS) - 1
#: Weights have 16 bits; what the two orders may have together leaves order 0 a 32nd of the range.
_FULL, _RATE = (1 << 16) - (1 << 11), 5
_U64 = np.uint64
_LOW = _U64(46)
_MASK = _U64((1 << 46) - 1)
#: Which order gives the id, from 2 * (order 2 is right) + (order 1 is right): 0 for order 2, 1 for order 1, 2 for order 0.
_WHICH = np.array([2, 1, 0, 0])
#: What the weights of order 1 and order 2 move towards.
_TOWARDS = np.array([[0, _FULL, 0], [_FULL, 0, 0]], np.int32)


class Frequencies:
    """The order-0 table of a header: classes of ids, and each id's share of its class."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray, share: np.ndarray):
        self.ids, self.classes, self.share = ids, classes, share
        own = np.bincount(classes, share, CLASSES).astype(np.int64)
        self.start = np.cumsum(share) - share - (np.cumsum(own) - own)[classes]
        # Of every id: its class, the start of its share (16 bits) and its width (17 bits).
        self.of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        self.of[ids] = (classes << 33) + (self.start << 17) + share

    def places(self) -> np.ndarray:
        """Of every class and unit of its share, the id that the unit belongs to."""
        out = np.zeros((CLASSES, 1 << _SHARE_BITS), np.int32)
        for c in range(CLASSES):
            own = self.classes == c
            if own.any():
                out[c] = np.repeat(self.ids[own], self.share[own])
        return out.ravel()

    @classmethod
    def count(cls, stream: np.ndarray) -> "Frequencies":
        n = np.bincount(stream)
        ids = np.argsort(-n, kind="stable")
        ids = ids[: int((n > 0).sum())]
        n = n[ids]
        classes = np.minimum((np.cumsum(n) - n) * CLASSES // max(int(n.sum()), 1), CLASSES - 1)
        total, size = np.bincount(classes, n, CLASSES), np.bincount(classes, minlength=CLASSES)
        share = 1 + (n * ((1 << _SHARE_BITS) - size[classes]) / total[classes]).astype(np.int64)
        first = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]) if len(ids) else np.zeros(0, np.int64)
        share[first] += (1 << _SHARE_BITS) - np.bincount(classes, share, CLASSES).astype(np.int64)[classes[first]]
        return cls(ids.astype(np.int64), classes.astype(np.int64), share)

    def to_bytes(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + self.ids.astype("<u4").tobytes()
                             + self.classes.astype("u1").tobytes() + (self.share - 1).astype("<u2").tobytes(), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Frequencies":
        raw = zlib.decompress(raw)
        n = struct.unpack_from("<I", raw)[0]
        at = lambda kind, start: np.frombuffer(raw, kind, n, start).astype(np.int64)
        return cls(at("<u4", 4), at("u1", 4 + 4 * n), at("<u2", 4 + 5 * n) + 1)


class _Model:
    """The predictions and weights of every lane; rows of its arrays are order 1 and order 2."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.lanes = lanes
        self.slot_base = (self.lane << SLOT_BITS) + np.array([[0], [lanes << SLOT_BITS]])
        # A slot holds the id last seen, times 4, plus how often it has just held, 3 at most (0: none yet).
        self.slots = np.zeros(2 * lanes << SLOT_BITS, np.int32)
        self.set_base = SETS * self.lane + np.array([[0], [SETS * lanes]])
        parts = np.array([(0 if agree else 12 * k1, 24 * k2 * k2) for k2 in range(4) for k1 in range(4) for agree in (0, 1)])
        first = (parts * _FULL // (parts.sum(axis=1) + 64)[:, None]).astype(np.int32).T
        self.weights = np.concatenate([np.tile(first[0], lanes), np.tile(first[1], lanes)])
        self.class_count = np.full(lanes * CLASSES, 4, np.int32)
        self.classes_at = self.lane * CLASSES
        self.cum_at = self.lane * (CLASSES + 1)
        self.one = np.zeros(lanes, np.uint32)
        self.two = np.zeros(lanes, np.uint32)
        self.hashed = np.zeros((2, lanes), np.uint32)
        self.rebuild()

    def rebuild(self):
        """Starts of the classes, by their counts, each class one unit at least."""
        cum = np.zeros((self.lanes, CLASSES + 1), np.int64)
        np.cumsum(self.class_count.reshape(-1, CLASSES), axis=1, out=cum[:, 1:])
        total = cum[:, -1:].copy()
        cum *= (1 << _CLASS_BITS) - CLASSES
        cum //= total
        cum += np.arange(CLASSES + 1)
        self.cum = cum.ravel()  # of lane i from i * (CLASSES + 1)

    def predict(self, n: int):
        """For the first n lanes: where order 1's part of the mixture starts, and where order 0's does."""
        h = self.hashed[:, :n]
        np.multiply(self.one[:n], np.uint32(0x9E3779B1), out=h[0])
        np.multiply(self.two[:n], np.uint32(0x85EBCA6B), out=h[1])
        h[1] += h[0]
        h[1] += np.uint32(0x27D4EB2F)
        self.at = (h >> np.uint32(32 - SLOT_BITS)) + self.slot_base[:, :n]
        slot = self.slots.take(self.at)
        self.k, self.p = slot & 3, slot >> 2
        own = (self.k[1] << 3) + (self.k[0] << 1)
        own += self.p[0] == self.p[1]
        self.own = self.set_base[:, :n] + own
        self.now = self.weights.take(self.own)
        f = (self.now >> 16 - _MIX_BITS) + 1
        return f[1], f[0] + f[1]

    def update(self, ids: np.ndarray, right: np.ndarray, which: np.ndarray):
        """right: whether each order's prediction is the id; which: see ``_WHICH``."""
        n = len(ids)
        move = _TOWARDS.take(which, axis=1)
        move -= self.now
        move >>= _RATE
        move += self.now
        self.weights[self.own] = move
        held = np.minimum(self.k, 2)
        held *= right
        held += (ids << 2) + 1
        self.slots[self.at] = held
        self.two[:n] = self.one[:n]
        self.one[:n] = ids


def _share(first: np.ndarray, wide: np.ndarray, own: np.ndarray, both: np.ndarray) -> None:
    """From start and width of classes to those of ids' order-0 parts of the range, in units; own: of ``Frequencies.of``."""
    first <<= _SHARE_BITS
    first += (own >> 17 & 0xFFFF) * wide
    wide *= own & 0x1FFFF
    rest = (1 << _MIX_BITS) - both
    first *= rest
    wide *= rest
    first += both.astype(np.int64) << _REST_BITS


def _order12(first: np.ndarray, wide: np.ndarray, some: np.ndarray, which: np.ndarray, f2: np.ndarray, both: np.ndarray) -> None:
    """Put the parts of orders 2 and 1 in place for the lanes ``some``, whose id they give."""
    two, a, b = which[some] == 0, f2[some].astype(np.int64), both[some].astype(np.int64)
    first[some] = np.where(two, 0, a) << _REST_BITS
    wide[some] = np.where(two, a, b - a) << _REST_BITS


def _learn(model: _Model, t: int, c: np.ndarray, sym: np.ndarray, right: np.ndarray, which: np.ndarray) -> None:
    model.class_count[model.classes_at[:len(c)] + c] += (which == 2) * np.int32(8)
    if t % REBUILD == REBUILD - 1:
        model.rebuild()
    model.update(sym, right, which)


def _turned(a: np.ndarray) -> np.ndarray:
    """The transpose, copied in tiles that a cache holds."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, a.shape[0], 64):
        for j in range(0, a.shape[1], 64):
            out[j:j + 64, i:i + 64] = a[i:i + 64, j:j + 64].T
    return out


def encode(ids: np.ndarray, freq: Frequencies) -> list[bytes]:
    """The payload of every block of BLOCK ids."""
    lanes = -(-len(ids) // BLOCK)
    steps = np.zeros(lanes * BLOCK, np.int32)
    steps[:len(ids)] = ids
    steps = _turned(steps.reshape(lanes, BLOCK))
    last = len(ids) - (lanes - 1) * BLOCK
    model = _Model(lanes)
    all_low, all_range = np.zeros(lanes, _U64), np.full(lanes, 1 << 62, _U64)
    out_lanes, out_digits = [], []
    for t in range(min(BLOCK, len(ids))):
        n = lanes if t < last else lanes - 1
        sym, low, rng = steps[t, :n], all_low[:n], all_range[:n]
        f2, both = model.predict(n)
        right = model.p == sym
        which = _WHICH.take(right[1] * np.int8(2) + right[0])
        own = freq.of.take(sym)
        c = own >> 33
        at = model.cum_at[:n] + c
        first, wide = model.cum.take(at), model.cum.take(at + 1)
        wide -= first
        _share(first, wide, own, both)
        _order12(first, wide, np.flatnonzero(which < 2), which, f2, both)
        unit = rng >> _UNITS
        low += unit * first.view(_U64)
        np.multiply(unit, wide.view(_U64), out=rng)
        out = np.flatnonzero(rng <= _MASK)
        while len(out):
            out_lanes.append(out.astype(np.uint16))
            own = low[out]
            out_digits.append((own >> _LOW).astype(np.int32))
            low[out] = (own & _MASK) << _U64(16)
            own = rng[out] << _U64(16)
            rng[out] = own
            out = out[own <= _MASK]
        _learn(model, t, c, sym, right, which)
    for _ in range(4):
        out_lanes.append(model.lane.astype(np.uint16))
        out_digits.append((all_low >> _LOW).astype(np.int32))
        all_low = (all_low & _MASK) << _U64(16)
    lane = np.concatenate(out_lanes)
    digits = np.concatenate(out_digits)[np.argsort(lane, kind="stable")]
    while len(carry := np.flatnonzero(digits > 0xFFFF)):
        digits[carry] &= 0xFFFF
        digits[carry - 1] += 1
    raw, cut = digits.astype("<u2").tobytes(), np.r_[0, 2 * np.cumsum(np.bincount(lane, minlength=lanes))].tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]


def decode(payloads: list[bytes], n_ids: int, freq: Frequencies) -> np.ndarray:
    """The ids of blocks encoded together; all but the last hold BLOCK ids."""
    lanes = len(payloads)
    digits = np.concatenate([np.frombuffer(b"".join(payloads), "<u2"), np.zeros(4, "<u2")]).astype(_U64)
    count = np.fromiter((len(p) // 2 for p in payloads), np.int64, lanes)
    # A code has 62 bits: three digits and 14 bits of the next, so later digits are read 2 bits off.
    all_at = np.cumsum(count) - count
    all_code = sum(digits[all_at + k] << _U64(46 - 16 * k) for k in range(3)) + (digits[all_at + 3] >> _U64(2))
    digits = (digits[:-1] << _U64(14) & _U64(0xFFFF)) + (digits[1:] >> _U64(2))
    all_at += 3
    all_range = np.full(lanes, 1 << 62, _U64)
    model, last, places = _Model(lanes), n_ids - (lanes - 1) * BLOCK, freq.places()
    out = np.zeros((min(BLOCK, n_ids), lanes), np.int32)
    for t in range(len(out)):
        n = lanes if t < last else lanes - 1
        code, rng, at_digit = all_code[:n], all_range[:n], all_at[:n]
        f2, both = model.predict(n)
        unit = rng >> _UNITS
        at = np.minimum((code // unit).view(np.int64), _LAST)
        mixed = at >> _REST_BITS
        # Quotients of numbers under 2**53 are exact to the whole number in double precision here, as the divisors are small.
        at -= both.astype(np.int64) << _REST_BITS
        np.maximum(at, 0, out=at)
        at = (at / ((1 << _MIX_BITS) - both)).astype(np.int64)
        low, c = at >> _SHARE_BITS, model.cum_at[:n].copy()
        for jump in (8, 4, 2, 1):
            c += jump * (model.cum.take(c + jump) <= low)
        first, wide = model.cum.take(c), model.cum.take(c + 1)
        wide -= first
        c -= model.cum_at[:n]
        at -= first << _SHARE_BITS
        at = (at / wide).astype(np.int64)
        at += c << _SHARE_BITS
        sym = places.take(at)
        some = np.flatnonzero(mixed < both)
        sym[some] = model.p[(mixed[some] < f2[some]).astype(np.int64), some]
        right = model.p == sym
        which = np.full(n, 2)
        which[some] = np.where(mixed[some] < f2[some], 0, 1)
        _share(first, wide, freq.of.take(sym), both)
        _order12(first, wide, some, which, f2, both)
        code -= unit * first.view(_U64)
        np.multiply(unit, wide.view(_U64), out=rng)
        more = np.flatnonzero(rng <= _MASK)
        while len(more):
            at = at_digit[more]
            code[more] = (code[more] << _U64(16)) + digits.take(at, mode="clip")
            at_digit[more] = at + 1
            own = rng[more] << _U64(16)
            rng[more] = own
            more = more[own <= _MASK]
        _learn(model, t, c, sym, right, which)
        out[t, :n] = sym
    return _turned(out).ravel()[:n_ids] if lanes > 1 else out.ravel()
