"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns' findings always stand.  Further candidates are runs of 16 or more
key characters, with a digit or a change from lower to upper case in them, and of
runs that findings touch the parts beside the findings.  Findings and candidates
all go with their surrounding text to a small convolutional network in numpy;
candidates over the threshold are added as kind "cnn".

The network is trained here on labelled findings (``labelled_findings``: secrets
and look-alikes in running text, from stated rules and a fixed seed, since the
tables hold no labels for secrets).  A second set calibrates its scores by Platt
scaling, and the threshold is the largest at which ``find`` catches a share of
``RECALL`` at least of those secrets of that set which the patterns don't find; one
that no candidate meets counts as missed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import coalesce, col, lit

KINDS = ("assign", "access", "hex", "cnn")
MASK = "[SECRET]"
RECALL = 0.98
FINDINGS = 4000
CONTEXT = 24

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = r"[A-Za-z0-9+/_.=-]{16,}"
_PATTERNS = {"assign": re.compile(_ASSIGN, re.I | re.A), "access": re.compile(r"AKIA[A-Z0-9]+"),
             "hex": re.compile(r"[0-9a-f]{24,}"), "run": re.compile(_RUN), "key": re.compile(r"[0-9]|[a-z][A-Z]")}
LEAST = 16


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """The patterns' findings (start, kind number, end) in order, and the further candidates (start, end)."""
    found, candidates, p = [], [], _PATTERNS
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in p["assign"].finditer(text) if m.end(2) - m.start(2) >= 6]
    # Access keys and hex strings are runs of key characters, so they lie within such runs.
    runs = [(m.start(), m[0]) for m in p["run"].finditer(text)]
    for at, run in runs:
        if "AKIA" in run:
            found += [(at + m.start(), 1, at + m.end()) for m in p["access"].finditer(run) if m.end() - m.start() >= 20]
        if len(run) >= 24:
            found += [(at + m.start(), 2, at + m.end()) for m in p["hex"].finditer(run)]
    found.sort()
    # Findings and runs side by side, both in order: what lies between findings is left of a run.
    k = covered = 0
    for at, run in runs:
        end = at + len(run)
        while k < len(found) and found[k][0] < end:
            candidates += _left(text, max(at, covered), found[k][0])
            covered = max(covered, found[k][2])
            k += 1
        candidates += _left(text, max(at, covered), end)
    return found, candidates


def _left(text: str, start: int, end: int) -> list[tuple]:
    return [(start, end)] if end - start >= LEAST and _PATTERNS["key"].search(text, start, end) else []


# -- the network ---------------------------------------------------------------------------------

_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \"':=/+-_.@,;()<>{}[]\n"
_OTHER, _NONE = len(_CHARS), len(_CHARS) + 1
_CODES = np.full(128, _OTHER, np.uint8)
_CODES[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_EMBED, _SPAN, _FILTERS, _HIDDEN = 8, 5, 24, 16


#: Positions that are convolved at a time.
_SLICE = 1 << 16


def _codes(text: str) -> np.ndarray:
    out = np.empty(len(text), np.uint8)
    for at in range(0, len(text), _SLICE):
        points = np.frombuffer(text[at:at + _SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        out[at:at + _SLICE] = np.where(points < 128, _CODES[np.minimum(points, 127)], _OTHER)
    return out


def windows(text_spans: list[tuple[str, int, int]]):
    """(rows, codes, inside) for spans of similar width: the whole span and CONTEXT characters around it."""
    by_width: dict[int, list[int]] = {}
    for i, (text, start, end) in enumerate(text_spans):
        size = min(len(text), end + CONTEXT) - max(0, start - CONTEXT)
        by_width.setdefault(max(64, 1 << (size - 1).bit_length()) if size <= _SLICE else size, []).append(i)
    for width, rows in by_width.items():
        step = max(1, (1 << 18) // width)
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            codes, inside = np.full((len(part), width), _NONE, np.uint8), np.zeros((len(part), width), bool)
            for j, i in enumerate(part):
                text, start, end = text_spans[i]
                low = max(0, start - CONTEXT)
                own = _codes(text[low:end + CONTEXT])
                codes[j, :len(own)], inside[j, start - low:end - low] = own, True
            yield np.array(part), codes, inside


@dataclass
class Network:
    """Embedding, one convolution with max pooling over positions, one hidden layer; then Platt scaling."""

    weights: list[np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, codes, inside):
        embed, w1, b1, w2, b2, w3, b3 = self.weights
        x = np.concatenate([embed[codes], inside[..., None]], axis=2)
        win = np.lib.stride_tricks.sliding_window_view(x, _SPAN, axis=1).reshape(len(x), -1, (_EMBED + 1) * _SPAN)
        z = win @ w1 + b1
        z[codes[:, :z.shape[1]] == _NONE] = -1e9
        at = z.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0)
        hidden = np.maximum(pooled @ w2 + b2, 0)
        return hidden @ w3 + b3, (win, at, pooled, hidden)

    def logits(self, text_spans: list[tuple[str, int, int]]) -> np.ndarray:
        embed, w1, b1, w2, b2, w3, b3 = self.weights
        # The convolution by the input's parts: what a character, or being inside, adds at each place of the window.
        by_place = w1.reshape(_EMBED + 1, _SPAN, _FILTERS)
        adds = np.einsum("ce,ekf->kcf", embed, by_place[:_EMBED])
        out = np.zeros(len(text_spans))
        for rows, codes, inside in windows(text_spans):
            last = codes.shape[1] - _SPAN + 1
            pooled = np.zeros((len(rows), _FILTERS))
            step = max(256, _SLICE // len(rows))
            for at in range(0, last, step):  # slices of the positions, of which only the largest value stays
                to = min(last, at + step)
                z = b1 + np.zeros((len(rows), to - at, _FILTERS))
                for k in range(_SPAN):
                    z += adds[k].take(codes[:, at + k:to + k], axis=0)
                    z += inside[:, at + k:to + k, None] * by_place[_EMBED, k]
                z[codes[:, at:to] == _NONE] = 0
                np.maximum(pooled, z.max(axis=1), out=pooled)
            out[rows] = np.maximum(pooled @ w2 + b2, 0) @ w3 + b3
        return out

    def scores(self, text_spans: list[tuple[str, int, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(text_spans) + self.shift, -50, 50)))

    def gradients(self, codes, inside, labels):
        embed, w1, b1, w2, b2, w3, b3 = self.weights
        logit, (win, at, pooled, hidden) = self._forward(codes, inside)
        d = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) / len(labels)
        d_hidden = np.outer(d, w3) * (hidden > 0)
        d_pool = (d_hidden @ w2.T) * (pooled > 0)
        best = np.take_along_axis(win, at[..., None], 1)  # the window that each filter chose
        g1 = np.einsum("nf,nfi->if", d_pool, best)
        d_win = (d_pool[..., None] * w1.T).reshape(len(codes), _FILTERS, _EMBED + 1, _SPAN)
        g_embed = np.zeros_like(embed)
        for k in range(_SPAN):
            np.add.at(g_embed, np.take_along_axis(codes, at + k, 1), d_win[..., :_EMBED, k])
        return [g_embed, g1, d_pool.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d, np.float64(d.sum())]


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, is a secret): half secrets, half look-alikes, in running text."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    b64 = lower + upper + digits
    word = lambda: pick(lower, int(rng.integers(2, 9)))
    secrets = [
        lambda: pick(b64, int(rng.integers(20, 64))),
        lambda: pick(b64 + "+/", int(rng.integers(28, 60))) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["ghp_", "sk-", "xox-", "pk_live_", "AIza", "glpat-"]) + pick(b64 + "_-", int(rng.integers(20, 40))),
        lambda: "eyJ" + pick(b64, 20) + "." + pick(b64, 30) + "." + pick(b64 + "_-", 40),
        lambda: pick(hexes.upper(), int(rng.choice([32, 40, 64]))),
        # Such as the patterns find; the network scores them too.
        lambda: pick(hexes, int(rng.choice([24, 32, 40, 64]))),
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: rng.choice(["password", "secret", "token", "API_KEY"]) + rng.choice(["=", ": ", ' = "']) + pick(b64, int(rng.integers(8, 40))),
    ]
    plain = [
        lambda: pick(digits, int(rng.integers(16, 20))),
        lambda: f"{word()}{rng.integers(1, 99)}.{word()}.example.com",
        lambda: f"{word()}/{word()}/{rng.integers(1900, 2030)}/{word()}.html",
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{pick(digits, 6)}",
        lambda: f"{word()}{word()}{word()}{rng.integers(0, 999)}.",
        lambda: f"{word()}-{word()}-{word()}-{rng.integers(1, 2000)}",
        lambda: f"{word()}_{word()}_v{rng.integers(1, 20)}.{rng.integers(0, 20)}.{word()}",
        lambda: "-" * int(rng.integers(8, 30)) + f"{rng.integers(1, 99)}" + "-" * 10,
        lambda: "+" + pick(digits, 3) + "-" + pick(digits, 4) + "-" + pick(digits, 8),
        lambda: "0." + pick(digits, int(rng.integers(15, 18))),
        lambda: word() + "".join(word().title() for _ in range(int(rng.integers(2, 5)))),
        lambda: word() + word() + word() + "." + word().title() + word(),
        lambda: "/".join(word() for _ in range(int(rng.integers(3, 7)))) + rng.choice(["", "/" + word().title(), f"/{rng.integers(1, 99)}"]),
    ]
    lead = ["key ", "credential: ", "auth=", "export KEY=", "Authorization: Bearer ", "pwd ", '"', "use ", ""]
    out = []
    for i in range(n):
        secret = i % 2
        makers = secrets if secret else plain
        value = makers[int(rng.integers(len(makers)))]()
        # The text around tells nothing by its case or marks: both labels get every style.
        case = (str.lower, str.lower, str.upper, str.title)[int(rng.integers(4))]
        marks = rng.choice(["", "", ",", "!!", "%%%", "***", "$$$", " |", "é", "ß"])
        prose = lambda: " ".join(case(word()) + marks for _ in range(int(rng.integers(0, 8))))
        before = prose() + " "
        if secret or rng.random() < 0.2:
            before += rng.choice(lead)
        after = rng.choice(["", "", marks]) + " " + prose()
        out.append((before + value + after, len(before), len(before) + len(value), secret))
    return out


@cache
def train(findings: int = FINDINGS, recall: float = RECALL, seed: int = 7, epochs: int = 6) -> Network:
    """Fit on ``findings`` labelled findings; calibrate and set the threshold on half as many others."""
    rng = np.random.default_rng(seed)
    size = (_EMBED + 1) * _SPAN
    net = Network([rng.normal(0, 0.3, (_NONE + 1, _EMBED)), rng.normal(0, size**-0.5, (size, _FILTERS)), np.zeros(_FILTERS),
                   rng.normal(0, _FILTERS**-0.5, (_FILTERS, _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, _HIDDEN**-0.5, _HIDDEN), np.float64(0)])
    data = labelled_findings(findings, seed)
    labels = np.array([d[3] for d in data], float)
    first, second, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 64):
            own = order[at:at + 64]
            step += 1
            grads = [np.zeros_like(w) for w in net.weights]
            for rows, codes, inside in windows([data[i][:3] for i in own]):
                share = len(rows) / len(own)
                for g, more in zip(grads, net.gradients(codes, inside, labels[own[rows]])):
                    g += more * share
            for i, g in enumerate(grads):  # Adam
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.weights[i] = net.weights[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    held = labelled_findings(findings // 2, seed + 1)
    logit, truth = net.logits([d[:3] for d in held]), np.array([d[3] for d in held], float)
    for _ in range(50):  # Platt scaling, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(net.scale * logit + net.shift, -50, 50)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - truth) * logit).sum() + 1e-3 * (net.scale - 1), (p - truth).sum() + 1e-3 * net.shift])
        hess = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        net.scale, net.shift = net.scale - move[0], net.shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    # Over all that find would see of the held texts: a secret's score is the best of the candidates that meet it.
    best = []
    for text, start, end, secret in held:
        if secret:
            found, candidates = scan(text)
            if any(s < end and start < e for s, _, e in found):
                continue
            own = [(text, s, e) for s, e in candidates if s < end and start < e]
            best.append(float(net.scores(own).max()) if own else 0.0)
    best = np.sort(best)[::-1]
    net.threshold = float(best[int(np.ceil(recall * len(best))) - 1])
    return net


# -- the operators -------------------------------------------------------------------------------

def find(texts: list[str], net: Network) -> list[list[tuple]]:
    """Of each text, all findings (start, kind number, end, the network's score), in order."""
    out, spans, owner = [[] for _ in texts], [], []
    for i, text in enumerate(texts):
        found, candidates = scan(text)
        spans += [(text, s, e) for s, _, e in found] + [(text, s, e) for s, e in candidates]
        owner += [(i, k) for _, k, _ in found] + [(i, 3)] * len(candidates)
    for (i, kind), (_, s, e), score in zip(owner, spans, net.scores(spans) if spans else ()):
        if kind < 3 or score >= net.threshold:
            out[i].append((s, kind, e, float(score)))
    for found in out:
        found.sort()
    return out


def _joined(found: list[tuple]) -> str:
    return ",".join(f"{KINDS[f[1]]}:{f[0]}:{f[2]}" for f in found)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans, scores.

    Offsets are code points, the end exclusive; scores are the network's for all
    spans, in their order, with four decimals.  Nulls: a null text is empty (no
    findings; base_sha256 is that of the empty string); a null id is kept.
    Repeated rows get a row each.  Empty table: empty result.
    """
    net = net or train()

    def run(batches):
        for b in batches:
            rows = []
            for found in find(b.column(1).to_pylist(), net):
                n = np.bincount([f[1] for f in found], minlength=4).tolist()
                base = _joined([f for f in found if f[1] < 3])
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), _joined(found), ",".join(f"{f[3]:.4f}" for f in found)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans", "scores"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), coalesce(col(text_col), lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string, scores string")


def mask(text: str, found: list[tuple]) -> str:
    """``text`` with each finding, or run of overlapping ones, replaced by MASK."""
    out, at = [], 0
    for start, _, end, _ in found:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", net: Network | None = None) -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text masked and ``chars_col``, if there, counted anew.

    Nulls: a null text stays null.  Rows without findings stay as they are; repeated
    rows stay each.  Other columns, whatever their names, pass through.  Empty
    table: empty result.
    """
    net = net or train()
    at, count = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            found = find([t or "" for t in texts], net)
            cols = list(b.columns)
            changed = [mask(t, f) if f else t for t, f in zip(texts, found)]
            cols[at] = pa.array(changed, cols[at].type)
            if count is not None:
                old = cols[count].to_pylist()
                cols[count] = pa.array([len(t) if f else n for t, f, n in zip(changed, found, old)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
