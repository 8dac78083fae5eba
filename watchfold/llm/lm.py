"""Document log-likelihoods by a gated recurrent language model in numpy.

Tokens are lower-cased words and one end for each document.  The model's output
softmax is factored: a class by the hidden state, then a word of the class.  The
``VOCABULARY`` most frequent tokens have words of their own, in classes by
frequency, and the state gives the word too.  All other words, however many, fall
into ``RARE`` classes by their last letters: the state gives the class, and so an
input and a target of its own, and within a class a word has its share of the
class's training tokens, (c + 1) / (N_class + V_class + 1), which leaves room for
one unknown word.  So the weights don't grow with the corpus, but the words and
counts that they rest on do, and the model's probabilities sum to one over the
known words and one unknown word a class.

Training is truncated backpropagation through windows of ``WINDOW`` steps, the
state carried from window to window, on all training documents: each of
``ROUNDS`` rounds takes a share of them.  A round's documents are dealt to
trainers by a hash of id and text, one for ``TRAINER_TOKENS`` tokens and at most
``TRAINERS``; every trainer learns on a copy of the weights, its documents in the
order of that hash, and the copies' mean, weighted by tokens, starts the next
round.  So the model doesn't depend on how rows lie in partitions.  The sums are
shuffled in ``PIECES`` parts, so no task or driver holds all copies.

Counts of all words are a table.  The ``HEAD`` most frequent go to the tasks (the
bound that lets them be broadcast); the other words of a document are looked up
by a join on the word, whose keys are rare and therefore never hot.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import coalesce, col, lit

from watchfold.llm.pieces import WordTable, in_blocks, space_words
from watchfold.llm.threads import one_thread
from watchfold.shared import Scratch

VOCABULARY = 4096
RARE = 96
HEAD = 300_000
HIDDEN = 16
#: Classes of ``VOCABULARY`` words.
CLASSES = 48
WINDOW = 32
LANES = 512
#: States whose class logits are held at a time; they fit a core's cache.
ROWS = 512
ROUNDS = 3
RATE = 0.1
PIECES = 16
TRAINER_TOKENS, TRAINERS = 4_000_000, (8, 4096)
#: Distinct words that a counting or looking task holds, and documents that are scored side by side.
DISTINCT = 700_000
SCORED = 2048
#: Tokens whose outputs are taken together where nothing is learned.
TOGETHER = 32_768
#: The end of a document; no word is empty.
END = b""


class Model:
    """The weights: rows of ``x`` are what each input adds to the gates, ``u`` what the state adds.

    ``classes`` and ``words`` give the logits; their last row and column are biases, which meet a state's constant one.
    """

    NAMES = ("x", "u", "classes", "words")

    def __init__(self, counts: np.ndarray, rare: np.ndarray, seed: int = 3):
        """counts: of the vocabulary's tokens, the end and then the most frequent first; rare: of all others, by class."""
        rng, k = np.random.default_rng(seed), len(counts)
        mass = np.cumsum(np.sqrt(counts))
        own = np.minimum((mass - np.sqrt(counts)) * CLASSES / max(mass[-1] if k else 1, 1e-9), CLASSES - 1).astype(np.int64)
        own = np.unique(own, return_inverse=True)[1].ravel()  # no class is empty
        self.classes = int(own.max()) + 1 if k else 0
        self.class_of = np.concatenate([own, self.classes + np.arange(len(rare))])  # rare classes come last
        self.low = np.searchsorted(own, np.arange(self.classes + 1))
        by_class = np.concatenate([np.bincount(own, counts, self.classes), rare]) + 0.5
        f32 = lambda a: np.asarray(a, np.float32)
        self.w = {
            "x": f32(rng.normal(0, 0.1, (k + len(rare) + 1, 3 * HIDDEN))), "u": f32(rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN))),
            "classes": f32(np.vstack([rng.normal(0, 0.1, (HIDDEN, len(by_class))), np.log(by_class / by_class.sum())])),
            "words": f32(np.column_stack([rng.normal(0, 0.1, (k, HIDDEN)), np.log(counts / by_class[own]) if k else np.zeros(0)]))}
        self.rare, self.start = k, k + len(rare)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            size = self.w[n].size
            self.w[n] = flat[at:at + size].astype(np.float32).reshape(self.w[n].shape)
            at += size

    def steps(self, tokens: np.ndarray, active: list[int], before: np.ndarray, h: np.ndarray, keep: bool):
        """States after each step of a window; tokens: (steps, lanes); active: lanes at each step, falling.

        A step's arrays hold a unit's values of all lanes in a row, so that numpy's inner loops are long.
        """
        x, hid = self.w["x"], HIDDEN
        u = np.ascontiguousarray(self.w["u"].T)
        u[:2 * hid] *= -1  # what the exponentials of the two gates take
        h = h.T
        states, kept = [], []
        for t, n in enumerate(active):
            inputs, old = before[:n] if t == 0 else tokens[t - 1, :n], h[:, :n]
            g, s = np.ascontiguousarray(x.take(inputs, axis=0).T), u @ old
            rz, past, new = s[:2 * hid], s[2 * hid:], g[2 * hid:]
            rz -= g[:2 * hid]
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            r, z = rz[:hid], rz[hid:]
            past *= r
            new += past
            np.tanh(new, out=new)
            change = old - new
            h = change * z
            h += new
            if keep:
                kept.append((inputs, old, r, z, new, past, change))
            states.append(h.T)
        return states, kept

    def outputs(self, states: list[np.ndarray], targets: np.ndarray, learn: bool):
        """Log-probabilities of the targets; with ``learn`` also the gradients of minus their sum."""
        classes, words, own = _bounded(self.w["classes"], 0), _bounded(self.w["words"], 1), self.class_of[targets]
        # All is done in the order of the classes, so that a class is a slice.
        order = np.argsort(own.astype(np.int16), kind="stable")
        own, targets = own[order], targets[order]
        states = _with_one(states).take(order, axis=0)
        logp, total = np.empty(len(targets), states.dtype), np.empty(len(targets), states.dtype)
        ones = np.ones(max(classes.shape[1], np.diff(self.low).max(initial=0)), states.dtype)
        if learn:
            by_unit, d_states = np.ascontiguousarray(states.T), np.empty((len(targets), HIDDEN), states.dtype)
            d_classes, d_words, d_in_class = np.zeros_like(classes.T, order="C"), np.zeros_like(words), np.zeros_like(d_states)
        for a in range(0, len(targets), ROWS):
            at = slice(a, a + ROWS)
            logits, sums = states[at] @ classes, total[at]
            flat, mine = logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + own[at]
            logp[at] = flat[mine]
            np.exp(logits, out=logits)
            np.dot(logits, ones[:logits.shape[1]], out=sums)
            if learn:
                # The narrow factor is divided by the sums, not the wide one.
                flat[mine] -= sums
                d_classes += logits.T @ (by_unit[:, at] / sums).T
                np.divide(logits @ classes[:-1].T, sums[:, None], out=d_states[at])
        logp -= np.log(total)
        cut = np.searchsorted(own, np.arange(self.classes + 1))
        n, size, low = int(cut[-1]), np.diff(self.low), self.low.tolist()
        total[:] = 1
        # Where each target lies in the logits of its class; classes of one word add nothing.
        place = (np.arange(n) - cut[own[:n]]) * size[own[:n]] + targets[:n] - self.low[own[:n]]
        logp[:n] += np.where(size[own[:n]] > 1, np.einsum("ij,ij->i", states[:n], words.take(targets[:n], axis=0)), 0)
        cuts = cut.tolist()
        for c in np.flatnonzero((np.diff(cut) > 0) & (size > 1)).tolist():
            a, b = cuts[c], cuts[c + 1]
            some, mine, sums = states[a:b], words[low[c]:low[c + 1]], total[a:b]
            logits = np.dot(some, mine.T)
            np.exp(logits, out=logits)
            np.dot(logits, ones[:len(mine)], out=sums)
            if learn:
                logits.reshape(-1)[place[a:b]] -= sums
                logits /= sums[:, None]
                np.dot(logits.T, some, out=d_words[low[c]:low[c + 1]])
                np.dot(logits, mine[:, :-1], out=d_in_class[a:b])
        logp -= np.log(total)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        if not learn:
            return logp[back]
        d_states += d_in_class
        return logp[back], d_states.take(back, axis=0), {"classes": np.ascontiguousarray(d_classes.T), "words": d_words}

    def backward(self, kept: list, d_states: list[np.ndarray], grads: dict) -> None:
        """Truncated backpropagation: gradients of the gates' weights from those of each step's state."""
        hid, u, end = HIDDEN, self.w["u"], sum(map(len, d_states))
        d_u, gates = np.zeros_like(u.T, order="C"), np.empty((end, 3 * hid), u.dtype)
        d_next = None
        for (_, old, r, z, new, past, change), d in zip(reversed(kept), reversed(d_states)):
            d, d_s = d.T.copy(), np.empty((3 * hid, len(d)), u.dtype)
            if d_next is not None:
                d[:, :d_next.shape[1]] += d_next
            d_r, d_z, d_past = d_s[:hid], d_s[hid:2 * hid], d_s[2 * hid:]
            stays = d * z
            d -= stays
            np.multiply(change, d, out=d_z)
            d_z *= z
            np.multiply(new, new, out=d_r)
            d_r *= d
            d -= d_r  # of what tanh takes
            np.multiply(d, r, out=d_past)
            np.subtract(d, d_past, out=d_r)
            d_r *= past
            at = slice(end - d.shape[1], end)
            gates[at, :2 * hid], gates[at, 2 * hid:] = d_s[:2 * hid].T, d.T
            end = at.start
            d_u += d_s @ old.T
            d_next = u @ d_s
            d_next += stays
        grads["u"], grads["x"] = d_u.T.copy(), (np.concatenate([k[0] for k in kept]), gates)


def _with_one(states: list[np.ndarray]) -> np.ndarray:
    """All states in a row, and a constant one that meets the biases."""
    out = np.ones((sum(map(len, states)), HIDDEN + 1), states[0].dtype)
    np.concatenate(states, out=out[:, :-1])
    return out


def _bounded(weights: np.ndarray, axis: int) -> np.ndarray:
    """The weights, those of logits that could pass 60 scaled down to it: a state is within 1, so no exponential overflows."""
    most, ones = np.abs(weights), np.ones(weights.shape[axis], weights.dtype)
    most = (most @ ones)[:, None] if axis else (ones @ most)[None]
    return weights if most.max(initial=0) <= 60 else weights * np.minimum(1, 60 / most, dtype=weights.dtype)


class Trainer:
    """Adagrad over windows of side-by-side documents, the longest first."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.tokens = model, rate, 0
        self.seen = {n: np.full_like(a, 1e-3) for n, a in model.w.items()}

    def learn(self, docs: list[np.ndarray]) -> None:
        docs = sorted(docs, key=len, reverse=True)
        for at in range(0, len(docs), LANES):
            self._group(docs[at:at + LANES])

    def _group(self, docs: list[np.ndarray]) -> None:
        model = self.model
        h, before = np.zeros((len(docs), HIDDEN), np.float32), np.full(len(docs), model.start)
        for tokens, active in _windows(docs):
            states, kept = model.steps(tokens, active, before, h, keep=True)
            targets = np.concatenate([tokens[t, :n] for t, n in enumerate(active)])
            _, d, grads = model.outputs(states, targets, learn=True)
            ends = np.cumsum(active).tolist()
            model.backward(kept, [d[end - n:end] for n, end in zip(active, ends)], grads)
            self._update(grads, len(targets))
            n = active[-1]
            h, before = states[-1], tokens[len(active) - 1, :n]

    def _update(self, grads: dict, n: int) -> None:
        self.tokens += n
        scale = np.float32(1 / np.sqrt(n))
        rows, gates = grads.pop("x")
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # VOCABULARY and RARE are far below 65,536; 16 bits sort by radix
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rows = rows[first]
        g = np.add.reduceat(gates.take(order, axis=0), first, axis=0)
        g *= scale
        square = g * g
        square += self.seen["x"].take(rows, axis=0)
        self.seen["x"][rows] = square
        g *= self.rate
        g /= np.sqrt(square, out=square)
        self.model.w["x"][rows] -= g
        for name, g in grads.items():
            g *= scale
            square = g * g
            self.seen[name] += square
            g *= self.rate
            g /= np.sqrt(self.seen[name], out=square)
            self.model.w[name] -= g


def _windows(docs: list[np.ndarray]):
    """(tokens of WINDOW steps by lanes, lanes at each step) for documents side by side, the longest first."""
    length = np.array([len(d) for d in docs])
    flat, start = np.concatenate(docs) if len(docs) else np.zeros(0, np.int64), np.cumsum(length) - length
    for at in range(0, int(length[0]) if len(docs) else 0, WINDOW):
        n = int((length > at).sum())
        steps = np.arange(at, min(at + WINDOW, int(length[0])))[:, None]
        # Past its end a document shows some other token; such lanes aren't active.
        tokens = flat.take(np.minimum(start[:n] + steps, len(flat) - 1))
        yield tokens, (length[:n] > steps).sum(axis=1).tolist()


def score(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of whole documents of token ids, the state carried through all windows."""
    out = np.zeros(len(docs))
    by = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for at in range(0, len(by), SCORED):
        own = by[at:at + SCORED]
        group = [docs[i] for i in own]
        total, h, before = np.zeros(len(group)), np.zeros((len(group), HIDDEN), np.float32), np.full(len(group), model.start)
        held, n = [], 0

        def add() -> None:
            """What the windows held so far give; nothing is learned in between, so their outputs can be taken together."""
            states, targets, lanes = (sum(own, []) for own in zip(*held))
            logp = model.outputs(states, np.concatenate(targets), learn=False)
            total[:] += np.bincount(np.concatenate(lanes), logp, len(group))
            held.clear()

        for tokens, active in _windows(group):
            states, _ = model.steps(tokens, active, before, h, keep=False)
            held.append((states, [tokens[t, :n] for t, n in enumerate(active)], [np.arange(n) for n in active]))
            n += sum(active)
            if n >= TOGETHER:
                add()
                n = 0
            h, before = states[-1], tokens[len(active) - 1, :active[-1]]
        if held:
            add()
        out[own] = total
    return out


# -- over a corpus -------------------------------------------------------------------------------

def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32(id as text) mod 7 is 2; false for a null id."""
    return coalesce(F.crc32(col(id_col).cast("string")) % 7 == 2, lit(False))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _count(batches):
    words: list[bytes] = []
    counts, ends = np.zeros(1 << 16, np.int64), 0

    def number(new):
        words.extend(new)
        return np.arange(len(words) - len(new), len(words), dtype=np.int32)

    def batch():
        nonlocal ends
        out = pa.RecordBatch.from_arrays([pa.array([*words, END], pa.binary()), pa.array([*counts[:len(words)].tolist(), ends], pa.int64())], ["word", "n"])
        words.clear()
        table.clear()
        counts[:], ends = 0, 0
        return out

    table = WordTable(number)
    for b in batches:
        for block in in_blocks(b.column(0).to_pylist()):
            raw, start, end, _ = space_words(block)
            n = np.bincount(table(raw, start, end), minlength=len(words))
            if len(n) > len(counts):
                counts = np.concatenate([counts, np.zeros(max(len(counts), len(n)), np.int64)])
            counts[:len(n)] += n
            ends += len(block)
            if len(words) > DISTINCT:
                yield batch()
    if ends:
        yield batch()


@cache
def _rare_by_end() -> tuple[np.ndarray, np.ndarray]:
    """Minus one, less the rare class, of words by their only byte and by their last two bytes."""
    one, two = [bytes([a]) for a in range(256)], [bytes([a, b]) for a in range(256) for b in range(256)]
    return tuple(np.array([-1 - zlib.crc32(w) % RARE for w in ends], np.int32) for ends in (one, two))


class Places:
    """Words to their places in a packed list; of other words minus one, less their rare class.

    The list alone is held, so memory doesn't grow with the words that are met.
    """

    def __init__(self, packed: bytes):
        words = zlib.decompress(packed).split(b"\n")[:-1]
        of = {w: i for i, w in enumerate(words)}
        self.end = np.int32(of.get(END, -1 - zlib.crc32(END) % RARE))
        self.table = WordTable(lambda new: np.array([of[w] for w in new], np.int32))
        raw, start, end, _ = space_words([b" ".join(words)])
        self.table.add(raw, start, end, np.array([i for i, w in enumerate(words) if w != END], np.int32))

    def _places(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        places = self.table.find(raw, start, end)
        one, two = _rare_by_end()
        other = np.flatnonzero(places == self.table.UNKNOWN)
        last, length = end[other], end[other] - start[other]
        places[other] = np.where(length > 1, two.take(raw.take(last - 2).astype(np.int32) << 8 | raw.take(last - 1), mode="clip"), one.take(raw.take(last - 1)))
        return places

    def __call__(self, texts: list[bytes]):
        """For every text: the places of its words and its end, and a function from positions of words to the words."""
        for block in in_blocks(texts):
            raw, start, end, count = space_words(block)
            cut = np.cumsum(count)
            places, kept = np.split(self._places(raw, start, end), cut[:-1]), raw.tobytes()
            for own, last, n in zip(places, cut.tolist(), count.tolist()):
                first = last - n
                yield np.append(own, self.end), lambda at, first=first: [
                    kept[a:b] for a, b in zip(start[first + at].tolist(), end[first + at].tolist())]


@lru_cache(maxsize=2)
def _lookup(packed: bytes) -> Places:
    return Places(packed)


def _pack(words: list[bytes]) -> bytes:
    return zlib.compress(b"".join(w + b"\n" for w in words), 1)


def _rare_class(word: Column) -> Column:
    """What ``_Places`` takes as the class of a word that isn't in its list."""
    return F.pmod(F.crc32(F.when(F.length(word) > 2, F.substring(word, -2, 2)).otherwise(word)), F.lit(RARE))


class Corpus:
    """Counts of a corpus's training tokens and the model trained on them."""

    def __init__(self, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str):
        self.spark, self.scratch, self.id_col = docs.sparkSession, scratch, id_col
        self.docs = docs.select(col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                                coalesce(col(text_col).cast("binary"), lit(b"")).alias("text"))
        self.training = self.docs.where(~col("held_out"))
        counted = self.training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        self.counts = scratch.write("counts", counted)
        total = self.counts.agg(F.sum("n"), F.count(lit(1))).first()
        self.n, self.v = total[0] or 0, total[1]
        # The least count of the head, from how many words have each count; only the head itself reaches the driver.
        room, least = HEAD, None
        for r in self.counts.groupBy("n").agg(F.count(lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
            room, least = room - r.words, (r.n if room >= r.words else least)
            if room <= 0:
                break
        wanted = (col("word") == lit(END)) | (lit(False) if least is None else col("n") >= least)
        head = self.counts.where(wanted).select("word", "n").toArrow()
        words, n = head.column(0).to_pylist(), head.column(1).to_numpy()
        by = sorted(range(len(words)), key=lambda i: (words[i] != END, -n[i], words[i]))  # the end has a place of its own in any case
        self.words, self.head = [words[i] for i in by], n[by].astype(np.int64)
        own = self.head[:VOCABULARY].astype(float)
        # Tokens and words of every rare class: all of the class less those with words of their own.
        self.rare_n, self.rare_v = np.zeros(RARE), np.zeros(RARE)
        for r in self.counts.groupBy(_rare_class(col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count(lit(1)).alias("v")).collect():
            self.rare_n[r.c], self.rare_v[r.c] = r.n, r.v
        for word, n in zip(self.words[:VOCABULARY], own):
            c = zlib.crc32(word[-2:]) % RARE
            self.rare_n[c] -= n
            self.rare_v[c] -= 1
        self.model = Model(own, self.rare_n)

    def train(self) -> None:
        trainers = int(min(max(self.n // TRAINER_TOKENS, TRAINERS[0]), TRAINERS[1]))
        keyed = self.training.withColumn("h", F.xxhash64("doc_id", "text"))
        for r in range(ROUNDS):
            share = keyed.where(F.pmod("h", lit(ROUNDS)) == r).withColumn("trainer", F.pmod(F.shiftrightunsigned("h", 8), lit(trainers)).cast("int"))
            # A trainer's documents are sorted, so that their order is the same wherever they lay.
            share = share.repartitionById(trainers, col("trainer")).sortWithinPartitions("h").select("trainer", "text")
            sent = self.spark.sparkContext.broadcast((self.model, _pack(self.words[:VOCABULARY])))
            parts = share.mapInArrow(_trainer(sent, RATE / (1 + r)), "piece int, trainer int, weights binary, tokens double")
            parts = parts.repartition(4 * PIECES, col("piece"), col("trainer") % 4).sortWithinPartitions("piece", "trainer")
            summed = parts.mapInArrow(_sum, "piece int, first int, weights binary, tokens double").collect()
            if summed:
                pieces, n = {}, {}
                for row in sorted(summed, key=lambda row: (row.piece, row.first)):  # PIECES parts by 4 at most from each task that sums
                    pieces[row.piece] = pieces.get(row.piece, 0) + np.frombuffer(row.weights, np.float64)
                    n[row.piece] = n.get(row.piece, 0) + row.tokens
                self.model.set_flat(np.concatenate([pieces[k] / n[k] for k in sorted(pieces)]))

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
        room = np.log10(self.rare_n + self.rare_v + 1)
        sent = self.spark.sparkContext.broadcast((self.model, _pack(self.words), self.head, room))
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        rows = self.docs.mapInArrow(_scorer(sent), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                    "logs double, model double, word binary, n long")
        rows = self.scratch.write("scored", rows)
        words = rows.where(col("word").isNotNull()).select("row", "word", col("n").alias("times"))
        c = coalesce("n", lit(0))
        found = words.join(self.counts, "word", "left").groupBy("row").agg(
            F.sum(col("times") * F.log10(c + 1)).alias("more_logs"), F.sum(F.when(c > 0, col("times")).otherwise(0)).alias("more_known"))
        docs = rows.where(col("word").isNull()).drop("word", "n").join(found, "row", "left")
        more_logs, more_known = coalesce("more_logs", lit(0.0)), coalesce("more_known", lit(0))
        base = col("logs") + more_logs - col("n_tokens") * float(np.log10(self.n + self.v + 1))
        return docs.select("doc_id", "held_out", "n_tokens", (col("n_known") + more_known).alias("n_known"),
                           lit(self.n).cast("long").alias("train_tokens"), base.alias("base_score"), (col("model") + more_logs).alias("score"))


def _trainer(sent, rate: float):
    def run(batches):
        one_thread()
        model, words = sent.value
        # A copy: a worker process keeps what was sent for the next trainer that it runs.
        place, trainer, number = _lookup(words), Trainer(copy.deepcopy(model), rate), None
        docs = []
        for b in batches:
            number = b.column(0)[0].as_py()
            for own, _ in place(b.column(1).to_pylist()):
                docs.append(np.where(own < 0, np.int32(model.rare - 1) - own, own))  # a rare class's place
                if len(docs) == 16 * LANES:
                    trainer.learn(docs)
                    docs = []
        trainer.learn(docs)
        if trainer.tokens:
            flat = np.array_split(trainer.model.flat().astype(np.float64) * trainer.tokens, PIECES)
            yield pa.RecordBatch.from_pylist(
                [{"piece": k, "trainer": number, "weights": part.tobytes(), "tokens": float(trainer.tokens)} for k, part in enumerate(flat)],
                schema=pa.schema([("piece", pa.int32()), ("trainer", pa.int32()), ("weights", pa.binary()), ("tokens", pa.float64())]))

    return run


def _sum(batches):
    sums, n, first = {}, {}, {}
    for b in batches:
        for piece, trainer, weights, count in zip(*(c.to_pylist() for c in b.columns)):
            first.setdefault(piece, trainer)
            sums[piece] = sums.get(piece, 0) + np.frombuffer(weights, np.float64)
            n[piece] = n.get(piece, 0) + count
    if sums:
        yield pa.RecordBatch.from_pylist([{"piece": k, "first": first[k], "weights": sums[k].tobytes(), "tokens": n[k]} for k in sums], schema=pa.schema(
            [("piece", pa.int32()), ("first", pa.int32()), ("weights", pa.binary()), ("tokens", pa.float64())]))


def _scorer(sent):
    def run(batches):
        one_thread()
        model, words, counts, room = sent.value
        place, logs = _lookup(words), np.log10(counts + 1.0)
        # Of each word of the head: its place in the model, a rare class's for those without words of their own.
        in_model = np.arange(len(counts), dtype=np.int32)
        in_model[VOCABULARY:] = [model.rare + zlib.crc32(w[-2:]) % RARE for w in zlib.decompress(words).split(b"\n")[VOCABULARY:-1]]
        row = TaskContext.get().partitionId() << 33
        for b in (b.slice(at, 2 * SCORED) for b in batches for at in range(0, b.num_rows, 2 * SCORED)):
            docs, facts, other = [], [], []
            for at, word in place(b.column(2).to_pylist()):
                missing = np.flatnonzero(at < 0)
                unknown = word(missing[missing < len(at) - 1]) + [END] * int(at[-1] < 0)
                known = at[at >= 0]
                at[at >= 0] = in_model[known]
                at[missing] = model.rare - 1 - at[missing]
                docs.append(at)
                own_logs, rare = float(logs[known].sum()), at[at >= model.rare] - model.rare
                more = float(logs[known[known >= VOCABULARY]].sum()) - float(room[rare].sum())
                facts.append((row, len(at), len(known), own_logs, more))
                if unknown:
                    other.append((row, Counter(unknown)))
                row += 1
            f = list(zip(*facts)) or [()] * 5
            scores = score(model, docs) / np.log(10) + np.array(f[4], float)
            n = len(facts)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            facts = [pa.array(values, kind) for values, kind in zip(f, kinds)]
            yield pa.RecordBatch.from_arrays(
                [facts[0], b.column(0), b.column(1), *facts[1:], pa.array(scores), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
            if other:
                size = [len(c) for _, c in other]
                n = sum(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r for r, _ in other], size)), pa.nulls(n, b.column(0).type), pa.nulls(n, pa.bool_()),
                     *(pa.nulls(n, kind) for kind in kinds[1:]), pa.nulls(n, pa.float64()),
                     pa.array([w for _, c in other for w in c], pa.binary()), pa.array([k for _, c in other for k in c.values()], pa.int64())], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "model", "word", "n"]
    return run


def log_likelihoods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Nulls: a null text is empty (one token, its end); a null id is kept and not
    held out.  Repeated rows get a row each.  Empty table: empty result.
    """
    corpus = Corpus(docs, Scratch(docs.sparkSession, "lm"), id_col, text_col)
    corpus.train()
    return corpus.scores()
