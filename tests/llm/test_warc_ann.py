import base64
import hashlib

import numpy as np
import pytest

from watchfold.llm import ann, warc
from watchfold.shared import Scratch


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def test_keys_reverse_hosts():
    assert warc.url_key("https://m.Ex.net:80/a?b#c") == "net,ex,m)/a?b#c"
    assert warc.url_key("http://a.b?x=/1") == "b,a)/?x=/1"
    assert warc.url_key(None) == ""


def test_every_page_comes_back(pages):
    both = pages.union(pages.selectExpr("page_id + 100000", "url", "html"))
    got = {r.page_id: r for r in warc.round_trip(both).collect()}
    rows = both.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = r.html.encode()
        assert got[r.page_id].payload_bytes == len(raw) and got[r.page_id].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[r.page_id].record_type, got[r.page_id].refers_to) == (("response", None) if r.page_id >= 100000 else ("revisit", r.page_id + 100000))


def test_lookup_finds_all_captures(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "PART_CAPTURES", 40)
    archive = warc.write(pages.union(pages.limit(30)), Scratch(spark, "test"))
    got = warc.lookup(pages.select("url"), archive).collect()
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert len(archive.parts) > 1 and len(got) == pages.count() + 30
    assert all(html[r.page_id] == (r.url, bytes(r.payload).decode()) for r in got if r.record_type == "response")
    assert list(archive.lookup("http://nowhere.example/")) == []


def test_parts_grow_beyond_their_number(spark, pages, monkeypatch):
    for name, value in (("BLOCK_LINES", 3), ("PART_CAPTURES", 10), ("PARTS", 2), ("READ", 7)):
        monkeypatch.setattr(warc, name, value)
    archive = warc.write(pages, Scratch(spark, "test"))
    assert len(archive.parts) == 2
    got, want = warc.read(spark, archive).collect(), {r.page_id: r.html or "" for r in pages.collect()}
    assert {r.page_id: r.payload_bytes for r in got} == {i: len(h.encode()) for i, h in want.items()} and len(got) == len(want)


def test_damage_is_noticed():
    member = bytearray(warc._record(1, "http://a/", b"payload", "X" * 32, None, False))
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(bytes(member))


def test_warc_bears_odd_rows(spark):
    rows = [(1, "http://a.com/x", "p"), (2, "http://a.com/x", "p"), (3, None, None), (None, "http://b.com/\r\n é", ""), (4, "http://b.com/é", "zz"), (4, "http://b.com/é", "zz")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "revisit", 2), (2, "response", None), (3, "response", None), (None, "revisit", 3), (4, "response", None), (4, "response", None)], key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(df, least_bytes=3).collect()} == {"response"}


def test_nearest_has_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = ids[np.lexsort((ids, d))[:10]]
        own = sorted(by[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(s == d[ids == i][0] for _, i, s in own)
        recall.append(np.isin(true, [i for _, i, _ in own]).mean())
    assert np.mean(recall) >= 0.9


def test_nearest_bears_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [2.0, None]), (5, [1.0, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect()]
    assert sorted(got) == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
