import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.llm import toxicity

M = 1 << 64


def buckets(word):
    """The features of one word in plain Python: its prefixes of 3 to 7 characters, then all of it."""
    h, out = 0x1505, {}
    for k, c in enumerate(word, 1):
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % M
        h ^= h >> 29
        if 3 <= k <= 7:
            out[k] = 1 + (h + k - 1) % M % (toxicity.BUCKETS - 1)
    return [out.get(k, 0) for k in range(3, 8)] + [1 + (h ^ len(word) * 0x2545F4914F6CDD1D % M) % (toxicity.BUCKETS - 1)]


def brute_score(text, field):
    words = [w.lower() for w in re.findall(r"\w+", text)]
    odds = [math.exp(max(-30, min(30, sum(field.weights[b] for b in buckets(w))))) for w in words]
    step = [[1 / (1 + math.exp(t)), math.exp(t) / (1 + math.exp(t))] for t in field.trans]
    forward, alpha = [], [1.0, 0.0]
    for u in odds:
        alpha = [sum(alpha[a] * step[a][b] for a in (0, 1)) * (u if b else 1) for b in (0, 1)]
        alpha = [x / sum(alpha) for x in alpha]
        forward.append(alpha)
    beta, p = [1.0, 1.0], []
    for u, f in zip(reversed(odds), reversed(forward)):
        p.append(f[1] * beta[1] / (f[0] * beta[0] + f[1] * beta[1]))
        beta = [sum(step[a][b] * (u if b else 1) * beta[b] for b in (0, 1)) for a in (0, 1)]
        beta = [x / sum(beta) for x in beta]
    p.reverse()
    best = {}
    for w, q in zip(words, p):
        if q > 0.02:
            best[w] = max(q, best.get(w, 0))
    top, total = sorted(best.values(), reverse=True) + [0, 0, 0], sum(best.values())
    x = [*top[:3], math.log1p(total), math.log1p(1000 * total / (max(len(words), 1) + 20)), math.log1p(max(len(words), 1))]
    z = field.document[0] + sum(w * (v - m) / s for w, v, m, s in zip(field.document[1:], x, field.mean, field.spread))
    return 1 / (1 + math.exp(-z)), p


@pytest.fixture(scope="module")
def field(spark):
    return toxicity.fit(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))


def test_scores_and_spans_equal_brute_force(docs, field):
    texts = [r.text for r in docs.collect()][:60] + ["", "One", "two words", "ÄÖ Ü"]
    texts += [" ".join(random.Random(k).sample(" ".join(texts[:60]).split(), 400)) for k in range(5)]
    score, spans = toxicity.assess(texts, field)
    for text, got, own in zip(texts, score, spans):
        want, p = brute_score(text, field)
        assert math.isclose(got, want, rel_tol=1e-6, abs_tol=1e-9)
        assert own == ",".join(f"{m.start()}:{m.end()}" for m, q in zip(re.finditer(r"\w+", text), p) if q >= 0.5)


def test_features_see_the_whole_word():
    a, b = toxicity.features(["abcdefghijklmnopqrst", "abcdefghijklmnopqrsX"])
    assert (a[:-1] == b[:-1]).all() and a[-1] != b[-1]
    for word, got in zip(["", "ab", "abc", "ünï", "x" * 60], toxicity.features(["", "ab", "abc", "ünï", "x" * 60])):
        assert got.tolist() == buckets(word)


def test_long_runs_and_unspaced_scripts_are_further_tokens(field):
    tokens = lambda text: toxicity._pattern(text).findall(text)
    assert tokens("x" * 70 + " ab") == ["x" * 32, "x" * 32, "x" * 6, "ab"]
    assert tokens("漢字abc de") == ["漢", "字", "abc", "de"]
    bad = max(toxicity_words(field), key=lambda w: brute_score(w, field)[1][0])
    hidden = "a" * 32 + bad + " tail"  # past the first token of a long run
    assert toxicity.assess([hidden], field)[0] == toxicity.assess(["a" * 32 + " " + bad + " tail"], field)[0]


def toxicity_words(field):
    words = [f"{a}{b}{c}" for a in "bdfgkmprstvz" for b in ("a", "e", "i", "o", "u", "ra") for c in ("nk", "st", "mo", "le")]
    return sorted(words, key=lambda w: -sum(field.weights[b] for b in buckets(w)))[:5]


def test_spans_stand_where_lower_case_moves_words():
    class Always(toxicity.Field):
        pass

    field = Always(np.zeros(toxicity.BUCKETS), np.array([5.0, 5.0]), np.zeros(6), np.ones(6), np.zeros(7))
    text = "İİ İx plain"
    (spans,) = toxicity.assess([text], field)[1]
    assert spans == "0:2,3:5,6:11"


def test_the_sample_is_bounded_and_takes_an_id_once(spark, monkeypatch):
    rows = [(1, "b" * 50, 9)] * 5 + [(1, "other", 9), (2, None, 9), (3, "c" * 1000, 9), (None, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", seen.append)
    known = {i for i in (1, 2, 3) if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    toxicity.fit(docs, labels)
    assert len(seen[0]) == len(known) and {t for _, t in seen[0]} <= {0, 1}
    toxicity.fit(docs, labels, chars=60)
    assert sum(len(t) for t, _ in seen[1]) <= 60
    toxicity.fit(docs, labels, sample=1)
    assert len(seen[2]) <= 1
    assert docs.where(F.col("_id").isNull()).count() == 0
