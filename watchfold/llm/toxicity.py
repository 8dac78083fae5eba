"""Toxicity by a linear-chain conditional random field over tokens.

A token is a run of word characters, in lower case; a run of more than ``LONGEST``
is cut into further tokens, and of scripts without spaces each character is one.
Its features are the whole word and its prefixes, hashed.  The field has two labels (plain, toxic) and learns
from labelled tokens: those of labelled documents, where a token of a toxic
document is toxic if its word or a prefix of it is far more frequent in toxic
documents than in others.  Forward-backward marginals of all tokens of a whole
text give the offending spans, and their sums and largest values over the text's
distinct words go to a logistic model of the document's label.  The two are fit
on separate parts of the sample.

The sample is bounded by ``SAMPLE`` labelled documents and ``SAMPLE_CHARS``
characters, chosen by a hash of their ids, one row for each; everything else runs
over all documents.  Labels, language, source and id
are inputs of no score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import broadcast, coalesce, col, lit

from watchfold.llm.pieces import _Numbers
from watchfold.shared import Scratch

#: Labelled documents that are learned from, and their characters, at most.
SAMPLE = 6000
SAMPLE_CHARS = 32_000_000
LONGEST = 32
#: A word or prefix is toxic from so many toxic documents, and so many times the frequency in others, on.
LEAST_DOCS, LIFT = 4, 8.0
WINDOW, NEGATIVES = 64, 0.15
PREFIXES = (3, 4, 5, 6, 7)
BUCKETS = 1 << 18
REJECT = 0.7
SPAN = 0.5
#: Characters of text whose tokens are scored at a time; whole documents only.
CHARS = 4_000_000

_RUN = rf"\w{{1,{LONGEST}}}"
_run = re.compile(_RUN)
#: Scripts that don't part words: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_unspaced = re.compile(f"[{_UNSPACED}]").search
_any = re.compile(f"(?=[{_UNSPACED}])\\w|(?:(?![{_UNSPACED}])\\w){{1,{LONGEST}}}")


def _pattern(text: str) -> re.Pattern:
    return _run if text.isascii() or not _unspaced(text) else _any


class _Lowered:
    """Numbers of words, those of equal lower case the same."""

    def __init__(self):
        self.given, self.lowered = _Numbers(), _Numbers()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in a row, and how many each text has; the words of one text are held at a time."""
        rows, length = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = _pattern(text).findall(text)
            rows.append(np.fromiter(map(self.given.__getitem__, own), np.int32, len(own)))
            length[i] = len(own)
        to = np.fromiter((self.lowered[w.lower()] for w in self.given.new), np.int32, len(self.given.new))
        return to[np.concatenate(rows)], length

    @property
    def words(self) -> list[str]:
        return self.lowered.new


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's features, 0 for none: its prefixes, then the word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = max(int(size.max()) if len(size) else 0, max(PREFIXES))
    codes = np.array(words, f"U{wide}").view(np.uint32).reshape(len(words), wide).astype(np.uint64) if words else np.zeros((0, wide), np.uint64)
    out, h = np.zeros((len(words), len(PREFIXES) + 1), np.int64), np.full(len(words), 0x1505, np.uint64)
    for k in range(wide):
        on = size > k
        h = np.where(on, (h ^ codes[:, k]) * np.uint64(0x9E3779B97F4A7C15), h)
        h ^= np.where(on, h >> np.uint64(29), np.uint64(0))
        if k + 1 in PREFIXES:
            bucket = 1 + ((h + np.uint64(k)) % np.uint64(BUCKETS - 1)).astype(np.int64)
            out[:, PREFIXES.index(k + 1)] = np.where(on, bucket, 0)
    out[:, -1] = 1 + ((h ^ size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    return out


@dataclass
class Packed:
    """Sequences side by side, the longest first: step t holds the t-th token of all that have one."""

    order: np.ndarray  # sequences by length, longest first
    active: np.ndarray  # sequences at each step
    place: np.ndarray  # where each token of the plain order stands in the packed one

    @classmethod
    def of(cls, length: np.ndarray) -> "Packed":
        order = np.argsort(-length, kind="stable")
        longest = int(length.max()) if len(length) else 0
        active = len(length) - np.searchsorted(np.sort(length), np.arange(longest), "right")
        start = np.cumsum(active) - active
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        ends = np.cumsum(length)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length)
        return cls(order, active, start[step] + np.repeat(rank, length) if longest else step)


def marginals(emission: np.ndarray, packed: Packed, trans: np.ndarray, pairs: bool = False):
    """P(toxic) of every packed token by forward-backward; with ``pairs`` also P(toxic, toxic), P(plain, toxic) and P(toxic, plain) of neighbours.

    emission: each token's log-odds; trans: log-weights [to toxic from plain, from toxic] against plain.
    """
    up, (t0, t1) = np.exp(np.clip(emission, -30, 30)), np.exp(np.clip(trans, -30, 30))
    n, start = packed.active, np.cumsum(packed.active) - packed.active
    forward, backward = np.empty(len(emission)), np.empty(len(emission))
    # forward: P(toxic | tokens so far); backward: the share of toxic in what the rest of the tokens say.
    for t in range(len(n)):
        own = slice(start[t], start[t] + n[t])
        if t:
            before = forward[start[t - 1]:start[t - 1] + n[t]]
            z0, z1 = (1 - before) / (1 + t0), before / (1 + t1)
            odds = (z0 * t0 + z1 * t1) / (z0 + z1) * up[own]
        else:
            odds = t0 * up[own]
        forward[own] = odds / (1 + odds)
    for t in range(len(n) - 1, -1, -1):
        own = slice(start[t], start[t] + n[t])
        backward[own] = 0.5
        if t + 1 < len(n) and n[t + 1]:
            nxt = slice(start[t + 1], start[t + 1] + n[t + 1])
            after, u = backward[nxt], up[nxt]
            b0 = ((1 - after) + t0 * u * after) / (1 + t0)
            b1 = ((1 - after) + t1 * u * after) / (1 + t1)
            backward[start[t]:start[t] + n[t + 1]] = b1 / (b0 + b1)
    one, zero = forward * backward, (1 - forward) * (1 - backward)
    p = one / (one + zero)
    if not pairs:
        return p
    nxt = np.concatenate([np.arange(start[t + 1], start[t + 1] + n[t + 1]) for t in range(len(n) - 1)] or [np.zeros(0, np.int64)])
    now = np.concatenate([np.arange(start[t], start[t] + n[t + 1]) for t in range(len(n) - 1)] or [np.zeros(0, np.int64)])
    a, b, u = forward[now], backward[nxt], up[nxt]
    w00, w01 = (1 - a) / (1 + t0) * (1 - b), (1 - a) / (1 + t0) * t0 * u * b
    w10, w11 = a / (1 + t1) * (1 - b), a / (1 + t1) * t1 * u * b
    total = w00 + w01 + w10 + w11
    return p, now, w11 / total, w01 / total, w10 / total


@dataclass
class Field:
    """The random field's weights, and the logistic model of a document's label."""

    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    document: np.ndarray | None = None

    def tag(self, texts: list[str]):
        """Of all tokens in a row: word number and P(toxic); each text's number of tokens."""
        lowered = _Lowered()
        number, length = lowered(texts)
        words = lowered.words
        emission = np.concatenate([self.weights[features(words[at:at + 50_000])].sum(axis=1) for at in range(0, len(words), 50_000)]
                                  or [np.zeros(0)])
        packed = Packed.of(length)
        tokens = np.empty(len(number))
        tokens[packed.place] = emission[number]
        return number, marginals(tokens, packed, self.trans)[packed.place], length

    def inputs(self, number, p, length) -> np.ndarray:
        """What the document model sees of each text: its distinct words' sum and three largest marginals, by length too."""
        out = np.zeros((len(length), 6))
        doc = np.repeat(np.arange(len(length)), length)
        some = np.flatnonzero(p > 0.02)
        order = some[np.lexsort((-p[some], number[some], doc[some]))]
        d, w = doc[order], number[order]
        first = np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])] if len(order) else np.zeros(0, bool)
        order, d = order[first], d[first]
        total = np.bincount(d, p[order], len(length))
        by = np.lexsort((-p[order], d))
        rank = np.arange(len(by)) - np.searchsorted(d[by], d[by])
        for k in range(3):
            own = by[rank == k]
            out[d[own], k] = p[order[own]]
        n = np.maximum(length, 1)
        out[:, 3], out[:, 4], out[:, 5] = np.log1p(total), np.log1p(1000 * total / (n + 20)), np.log1p(n)
        return out

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        x = (inputs - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.document[1:] + self.document[0], -50, 50)))


def _mine(docs: list[tuple[np.ndarray, int]], buckets: np.ndarray) -> np.ndarray:
    """For each bucket, whether its word or prefix marks toxic documents; docs: distinct word numbers, and the label."""
    uses, in_docs, total = np.zeros((2, BUCKETS)), np.zeros(BUCKETS), np.zeros(2)
    seen = set()
    for own, toxic in docs:
        # Copies and near copies would pass their whole vocabulary off as typical; two min-hashes tell them.
        h = buckets[own, -1]
        key = (int((h * 40503 % 262139).min()), int((h * 30011 % 262133).min()), toxic)
        if key in seen:
            continue
        seen.add(key)
        b = buckets[own].ravel()
        np.add.at(uses[toxic], b, 1)
        total[toxic] += len(own)
        if toxic:
            in_docs[np.unique(b)] += 1
    lift = (uses[1] + 0.5) / (total[1] + 1) / ((uses[0] + 0.5) / (total[0] + 1))
    marks = (in_docs >= LEAST_DOCS) & (lift >= LIFT)
    marks[0] = False
    return marks


def train(sample: list[tuple[str, int]], seed: int = 11, steps: int = 60) -> Field:
    """Fit the field on two thirds of labelled texts (text, toxic), the document model on the others."""
    rng = np.random.default_rng(seed)
    fold = rng.random(len(sample)) < 2 / 3
    lowered = _Lowered()
    chosen = [(text, int(toxic)) for (text, toxic), own in zip(sample, fold) if own]
    number, length = lowered([text for text, _ in chosen])
    rows = [(own, toxic) for own, (_, toxic) in zip(np.split(number, np.cumsum(length)[:-1]), chosen) if len(own)]
    words = lowered.words
    buckets = features(words)
    marks = _mine([(np.unique(number), toxic) for number, toxic in rows], buckets)
    marked = marks[buckets].any(axis=1)
    seqs = []
    for number, toxic in rows:
        for at in range(0, len(number), WINDOW):
            own = number[at:at + WINDOW]
            if marked[own].any():
                seqs.append((own, marked[own] * toxic, 1.0))
            elif rng.random() < NEGATIVES:
                seqs.append((own, np.zeros(len(own)), 1 / NEGATIVES))
    field = Field(np.zeros(BUCKETS), np.array([-4.0, -4.0]))
    if seqs:
        size = np.array([len(s[0]) for s in seqs], np.int64)
        packed = Packed.of(size)
        number, truth, weight = (np.empty(int(size.sum()), t) for t in (np.int64, float, float))
        number[packed.place] = np.concatenate([s[0] for s in seqs])
        truth[packed.place] = np.concatenate([s[1] for s in seqs])
        weight[packed.place] = np.repeat([s[2] for s in seqs], size)
        scale = 1 / weight.sum()
        m = [np.zeros(BUCKETS), np.zeros(2)]
        v = [np.zeros(BUCKETS), np.zeros(2)]
        start = np.cumsum(packed.active) - packed.active
        for step in range(1, steps + 1):
            emission = field.weights[buckets].sum(axis=1)[number]
            p, now, p11, p01, p10 = marginals(emission, packed, field.trans, pairs=True)
            nxt = np.concatenate([np.arange(start[t], start[t] + packed.active[t]) for t in range(1, len(start))] or [np.zeros(0, np.int64)])
            by_word = np.bincount(number, (p - truth) * weight, len(words)) * scale
            grad = np.bincount(buckets.ravel(), np.repeat(by_word, buckets.shape[1]), BUCKETS) + 1e-7 * field.weights
            grad[0] = 0
            e0, e1 = np.exp(field.trans)
            first = slice(0, packed.active[0])
            # d/dt of the log-partition less that of the true labels; each step's weights are normalised by what they come from.
            g0 = (weight[nxt] * (p01 - e0 / (1 + e0) * (1 - p[now]) - (truth[nxt] - e0 / (1 + e0)) * (1 - truth[now]))).sum()
            g0 += (weight[first] * (p[first] - truth[first])).sum()
            g1 = (weight[nxt] * (p11 - e1 / (1 + e1) * p[now] - (truth[nxt] - e1 / (1 + e1)) * truth[now])).sum()
            for i, (g, x) in enumerate(((grad, field.weights), (np.array([g0, g1]) * scale, field.trans))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                x -= 0.3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    held = [s for s, own in zip(sample, fold) if not own] or sample
    parts = []
    for at in range(0, len(held), 500):
        number, p, size = field.tag([t for t, _ in held[at:at + 500]])
        parts.append(field.inputs(number, p, size))
    x, y = np.concatenate(parts) if parts else np.zeros((0, 6)), np.array([t for _, t in held], float)
    field.mean, field.spread = x.mean(axis=0) if len(x) else np.zeros(6), x.std(axis=0) + 1e-6 if len(x) else np.ones(6)
    x = np.c_[np.ones(len(x)), (x - field.mean) / field.spread]
    field.document = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ field.document, -50, 50)))
        ridge = 0.1 * np.r_[0, np.ones(x.shape[1] - 1)]
        hess = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(ridge + 1e-6)
        move = np.linalg.solve(hess, x.T @ (q - y) + ridge * field.document)
        field.document -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-7:
            break
    return field


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from: crc32(id as text) mod 3 is 1; false for a null id."""
    return coalesce(F.crc32(col(id_col).cast("string")) % 3 == 1, lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        chars: int = SAMPLE_CHARS) -> Field:
    """Train on at most ``sample`` labelled documents that aren't held out, those whose ids hash lowest, of ``chars`` characters together at most.

    Nulls: null labels and ids teach nothing, a null text is empty.  Of labels that
    repeat an id the largest counts, of its documents the one whose text hashes
    lowest.  Empty tables: a field that has learned nothing.
    """
    known = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(col(id_col).alias("labelled")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)  # the bound that lets it be broadcast
    texts = docs.select(col(id_col).alias("id"), coalesce(col(text_col), lit("")).alias("text"))
    rows = texts.join(broadcast(chosen), col("id") == col("labelled")).groupBy("id", "toxic").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write("sample", rows)
    size = rows.select(F.xxhash64("id").alias("h"), "id", F.length("text").alias("n")).toPandas().sort_values(["h", "id"])
    own = size["id"][size["n"].cumsum() <= chars].tolist()
    got = sorted((r.id, r.text, r.toxic) for r in rows.where(col("id").isin(own)).collect()) if own else []
    scratch.drop("sample")
    return train([(text, toxic) for _, text, toxic in got])


def toxicity(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, spans.

    spans: start:end of the offending tokens, in code points, comma-joined.
    Nulls: a null text is empty (scored like any text, no spans); a null id is
    kept and not held out.  Repeated rows get a row each.  Empty table: empty.
    """

    def run(batches):
        for b in batches:
            texts, rows, at, size = b.column(2).to_pylist(), [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= CHARS or i + 1 == len(texts):
                    rows += zip(*assess(texts[at:i + 1], field))
                    at, size = i + 1, 0
            score, spans = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array([int(s >= REJECT) for s in score], pa.int32()), pa.array(spans, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), coalesce(col(text_col), lit("")).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")


def assess(texts: list[str], field: Field) -> tuple[list[float], list[str]]:
    """Each text's score and offending spans."""
    number, p, length = field.tag(texts)
    score = field.scores(field.inputs(number, p, length))
    ends = np.cumsum(length)
    spans = [""] * len(texts)
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= SPAN), "right")).tolist():
        own = p[ends[i] - length[i]:ends[i]]
        found = _pattern(texts[i]).finditer(texts[i])
        spans[i] = ",".join(f"{m.start()}:{m.end()}" for m, bad in zip(found, (own >= SPAN).tolist()) if bad)
    return score.tolist(), spans


def accepted(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under REJECT, all columns as they were, whatever their names.

    Nulls: a null text scores as an empty one and stays null.  Repeated rows are
    judged each.  Empty table: empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            keep, first, size = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= CHARS or i + 1 == len(texts):
                    keep += [s < REJECT for s in assess(texts[first:i + 1], field)[0]]
                    first, size = i + 1, 0
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
