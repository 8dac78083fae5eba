"""Each stage against plain Python on what the stage before kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_models import brute as base_findings
from test_nearcopy import brute as first_of_component
from test_toxicity import brute_score
from tokenizers import Tokenizer

import corpus_pipeline
from watchfold.llm import exact, secrets, toxicity
from watchfold.shared import Scratch

SF = "/root/testdata/sf0.001"
RUN, KEY = re.compile(r"[A-Za-z0-9+/_.=-]{16,}"), re.compile(r"[0-9]|[a-z][A-Z]")


def masked(text, net):
    """The text with all that the patterns find, and all else that scores over the threshold, masked."""
    bad = np.zeros(len(text) + 1, bool)
    for s, _, e in base_findings(text):
        bad[s:e] = True
    spans = [(s, e) for s, _, e in base_findings(text)]
    for run in RUN.finditer(text):
        at = run.start()
        while at < run.end():
            to = at
            while to < run.end() and bad[to] == bad[at]:
                to += 1
            if not bad[at] and to - at >= 16 and KEY.search(text[at:to]):
                _, codes, inside = next(iter(secrets.windows([(text, at, to)])))
                logit = net._forward(codes, inside)[0][0]
                if 1 / (1 + np.exp(-(net.scale * logit + net.shift))) >= net.threshold:
                    spans.append((at, to))
            at = to
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_each_stage_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, columns = Scratch(spark, "test"), docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.write(f"stage{number}", stage(spark, before, SF))
        old = {r.doc_id: r for r in before.collect()}
        rows = docs.collect()
        new = {r.doc_id for r in rows}
        if name != "packing":
            assert docs.columns == columns and len(rows) == len(new)
        if name == "toxicity":
            field = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(old) - new == {i for i, r in old.items() if brute_score(r.text, field)[0] >= 0.7}
        elif name == "exact dedup":
            last = {}
            for i, r in old.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert new == set(last.values())
        elif name == "simhash near-dedup":
            ids = sorted(old)
            assert new == {ids[k] for k in first_of_component([old[i].text for i in ids])}
        elif name == "secret scan":
            net = secrets.train()
            assert {r.doc_id: r.text for r in rows} == {i: masked(r.text, net) for i, r in old.items()}
            assert all(r.n_chars == len(r.text) for r in rows if r.text != old[r.doc_id].text)
        else:
            library, pieces, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
            for r in rows:
                pieces[r.doc_id].append(r)
                sequences[r.sequence_id].append(r)
            assert new == set(old)
            for i, own in pieces.items():
                ids, at = np.array([*library.encode(old[i].text, add_special_tokens=False).ids, 1], "<u4"), 0
                for r in sorted(own, key=lambda r: r.start):
                    assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                    at += r.length
                assert at == len(ids)
            assert all(sum(r.length for r in own) <= 2048 for own in sequences.values())


def test_odd_documents_pass_through(spark):
    rows = [(1, None, None, None, None), (None, "text", "en", "s", 4), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 9000, "en", "s", 45000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = exact.kept_documents(docs)
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(None, "text"), (2, ""), (3, "word " * 9000)], key=str)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = defaultdict(int)
    for r in docs.collect():
        got[r.doc_id] += r.length
    # An empty text is one end id; nothing of a document is lost.
    assert got == {None: 2, 2: 1, 3: 9001}


def test_empty_table_passes_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
