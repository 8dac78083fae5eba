import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.llm import lm
from watchfold.shared import Scratch


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def brute_score(corpus, counts, text):
    """log10 probability of a text, one token after the other, from the weights and the training counts."""
    m, logs = corpus.model, 0.0
    w = {k: v.astype(np.float64) for k, v in m.w.items()}
    own = {word: i for i, word in enumerate(corpus.words[:lm.VOCABULARY])}
    rare = [word for word in counts if word not in own]
    n, v = Counter(), Counter()
    for word in rare:
        n[zlib.crc32(word[-2:]) % lm.RARE] += counts[word]
        v[zlib.crc32(word[-2:]) % lm.RARE] += 1
    h, before, hid = np.zeros(lm.HIDDEN), m.start, lm.HIDDEN
    for word in lm.tokens(text):
        g, s = w["x"][before], h @ w["u"]
        r, z = sigmoid(g[:hid] + s[:hid]), sigmoid(g[hid:2 * hid] + s[hid:2 * hid])
        new = np.tanh(g[2 * hid:] + r * s[2 * hid:])
        h = z * h + (1 - z) * new
        one = np.append(h, 1)
        c = zlib.crc32(word[-2:]) % lm.RARE
        before = own[word] if word in own else m.rare + c
        p = np.exp(one @ w["classes"])
        logs += math.log10(p[m.class_of[before]] / p.sum())
        if word in own:
            low, high = m.low[m.class_of[before]], m.low[m.class_of[before] + 1]
            p = np.exp(w["words"][low:high] @ one)
            logs += math.log10(p[before - low] / p.sum())
        else:
            logs += math.log10((counts[word] + 1) / (n[c] + v[c] + 1))
    return logs


@pytest.mark.parametrize("head", [300_000, 5000])
def test_scores_equal_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus = lm.Corpus(docs, Scratch(spark, "test"), "doc_id", "text")
    counts = Counter(w for r in docs.where(~lm.held_out("doc_id")).collect() for w in lm.tokens(r.text.encode()))
    assert corpus.rare_n.sum() == sum(counts.values()) - sum(corpus.head[:lm.VOCABULARY])
    corpus.train()
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = corpus.scores().collect()
    for r in rows[::40]:
        assert math.isclose(r.score, brute_score(corpus, counts, texts[r.doc_id].encode()), rel_tol=2e-4)
    held = [r for r in rows if r.held_out]
    # A tenth of a digit a token at least over the unigram base.
    assert np.sum([r.score - r.base_score for r in held]) > 0.1 * np.sum([r.n_tokens for r in held])


def test_the_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = []
    for n in (1, 7):
        corpus = lm.Corpus(docs.repartition(n), Scratch(spark, "test"), "doc_id", "text")
        corpus.train()
        models.append(corpus.model.flat())
    assert np.abs(models[0] - models[1]).max() == 0


def test_without_training_rows_nothing_is_known(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).where(lm.held_out("doc_id"))
    rows = lm.log_likelihoods(docs).collect()
    assert rows and {(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(True, 3, 0, 0)}
    assert all(r.score < 0 and r.base_score <= 0 for r in rows)


def test_places_hold_their_list_only():
    listed = [b"", b"the", b"a", b"fifteen-letters", b"fifteen-letters-and-more", b"\xc3\xa9t\xc3\xa9"]
    places = lm.Places(lm._pack(listed))
    texts = [b"The the a b fifteen-letters fifteen-letters-and-more fifteen-letterS-or-more", b"", b"x", b"\xc3\xa9t\xc3\xa9 \xff \x00\x00 ab\tzab",
             b" ".join(b"w%d" % i for i in range(5000))]
    place = {w: i for i, w in enumerate(listed)}
    for text, (got, words) in zip(texts, places(texts), strict=True):
        expected = lm.tokens(text)
        assert got.tolist() == [place.get(w, -1 - zlib.crc32(w[-2:]) % lm.RARE) for w in expected]
        assert words(np.arange(len(expected) - 1)) == expected[:-1]
    assert len(places.table) == 5  # 5,000 other words were met


def test_windows_are_scored_together(monkeypatch):
    rng = np.random.default_rng(1)
    model = lm.Model(np.sort(rng.integers(1, 100, 300))[::-1].astype(float), rng.integers(1, 50, lm.RARE).astype(float))
    docs = [rng.integers(0, model.start, n) for n in (2000, 1, 40, 33, 700)]
    calls, outputs = [], lm.Model.outputs
    monkeypatch.setattr(lm.Model, "outputs", lambda self, states, targets, learn: calls.append(len(targets)) or outputs(self, states, targets, learn))
    together = lm.score(model, docs)
    assert calls == [2774]
    monkeypatch.setattr(lm, "TOGETHER", 1)
    assert np.allclose(together, lm.score(model, docs), rtol=1e-6) and len(calls) == 1 + 63
