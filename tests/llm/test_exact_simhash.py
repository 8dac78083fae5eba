import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from watchfold.llm import exact, simhash


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["text"] or ""].append(r["doc_id"])
    return out


@pytest.mark.parametrize("first", [3, 48])
def test_exact_equals_grouping_by_text(docs, first, monkeypatch):
    monkeypatch.setattr(exact, "FIRST", first)
    rows = docs.collect()
    by_text = groups(rows)
    want = {r["doc_id"]: (max(by_text[r["text"]]), len(by_text[r["text"]])) for r in rows}
    got = exact.exact_dedup(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)


def test_exact_bears_odd_rows(odd, none):
    got = exact.exact_dedup(odd).collect()
    assert len(got) == 9
    same = [r for r in got if r.keep_id == 2]
    assert [r.group_size for r in same] == [3, 3, 3] and sum(r.kept for r in same) == 1  # repeated rows: one stays
    assert {r.doc_id for r in got if r.keep_id == 4} == {3, 4}  # null is empty
    assert [r.kept for r in got if r.doc_id is None] == [True]
    kept = exact.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert exact.exact_dedup(none).count() == 0 and exact.kept_documents(none).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps, radius=3):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ a) <= radius):
            a_, b_ = find(i), find(int(j))
            label[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_equal_brute_force(docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)[:120]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs.where(docs.doc_id.isin(list(fps)))).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    ids = list(fps)
    label = components(np.array([fps[i] for i in ids], np.uint64))
    assert {i: ids[k] for i, k in zip(ids, label)} == {i: r.component_id for i, r in got.items()}


@pytest.mark.parametrize("crowded", [2048, 1])
def test_no_link_is_lost_in_trees(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = [base]
    for _ in range(5):
        x = base.copy()
        for _ in range(rng.integers(1, 4)):
            x ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        fps.append(x)
    fps = np.unique(np.concatenate(fps))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        a, b = find(at[a]), find(at[b])
        label[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == components(fps)


def test_simhash_bears_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 9
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {3, 4, 7} and {r.component_id for r in got if r.doc_id in zero} == {3}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id IN (2, 4, 7)").count() == 0
    assert simhash.near_duplicates(none).count() == 0
