import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from watchfold.llm import bpe, mixing, packing, tokenfile, words

BPE, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(4)
    texts = ["", "a" * 700, "ab" * 300, " \n\n  x  \x85\xa0 y", "\x1c\x1d a", "日本語 テキスト 👍🏽 naïve", "İstanbul Σας ſ K", "ﬁ½²³ 12345678 " * 9, "it's we'RE 'll !!'s ''", "<|endoftext|>"]
    return texts + ["".join(rng.choice("abcdeht  \n\xa0é!.,1½日'") for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_byte_bpe_equals_the_library_and_decodes():
    codec = bpe.load(BPE, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text, ids in zip(odd_texts(), codec.encode(odd_texts())):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_matrix_and_heap_agree():
    codec = bpe.load(BPE, P.PATTERN)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("theringo") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    ids, count = codec.encode_pieces(pieces)
    parts = np.split(ids, np.cumsum(count)[:-1])
    assert all(a.tolist() == codec._by_heap(p.encode()) or p.encode() in codec.ranks for a, p in zip(parts, pieces))


def test_bpe_operators(odd, none):
    rows = bpe.digests(odd, BPE, P.PATTERN).collect()
    encoded = bpe.encode(odd, BPE, P.PATTERN)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in rows:
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded, BPE, P.PATTERN).collect()} == texts
    assert bpe.digests(none, BPE, P.PATTERN).count() == 0


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_words_equal_the_library():
    assert [x.tolist() for x in words.load(WORDS).encode(odd_texts())] == library_ids(odd_texts())


def test_splitting_equals_the_library():
    rng = random.Random(9)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "\n", "9", "½", "é", "À", "!", "''", "\x00", "\x85", "\xa0", "abcdefghijklmno", "x", "µ", "\x1f"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(800)] + ["'", "", "it's", "'s"]
    tokenizer = words.WordTokenizer(WORDS)
    tokenizer.table.most = 50  # starts anew again and again
    for at in range(0, len(texts), 100):
        assert [x.tolist() for x in tokenizer.encode(texts[at:at + 100])] == library_ids(texts[at:at + 100])
    texts = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 18))) for _ in range(40_000)]  # the table grows
    tokenizer = words.WordTokenizer(WORDS)
    for part in (texts[:15_000], texts[10_000:]):
        assert [x.tolist() for x in tokenizer.encode([" ".join(part[at:at + 50]) for at in range(0, len(part), 50)])] == \
            library_ids([" ".join(part[at:at + 50]) for at in range(0, len(part), 50)])


def test_strings_of_added_tokens_are_the_librarys():
    texts = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "é <|startoftext|", "日本 <|endoftext|>", "<|endoftext|>" * 50]
    assert [x.tolist() for x in words.load(WORDS).encode(texts)] == library_ids(texts)
    assert library_ids(texts[:1]) == [[3306, 49407, 1002]]


@pytest.mark.parametrize("limits, share", [(packing.Limits(), None), (packing.Limits(64, 3, 20), "doc_id % 2 = 0"), (packing.Limits(256, 200, 100), "doc_id % 3 > 0"),
                                           (packing.Limits(512, 2, 512), None)])
def test_packing_places_every_id_once_within_the_limits(docs, limits, share):
    from pyspark.sql.functions import expr

    rows = docs.collect()
    whole = {r.doc_id: np.array([*ids, 1], "<u4") for r, ids in zip(rows, library_ids([r.text for r in rows]))}
    got = packing.pack(docs, WORDS, 1, limits, bears_loss=expr(share) if share else None).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in whole.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        own = [r for r in pieces if not share or eval(share.replace(" = ", " == "), {"doc_id": r.doc_id})]
        # The end id bears none.
        assert [r.loss_tokens for r in own] == [r.length - (r.start + r.length == r.doc_tokens) for r in own]
        assert sum(r.loss_tokens for r in pieces) == sum(r.loss_tokens for r in own) <= limits.loss
        padding += limits.tokens - at if at & (at - 1) else 0
    if limits == packing.Limits():
        assert padding == 0
    else:  # each limit that is set low is reached
        tokens, loss, count = (max(sum(f(r) for r in own) for own in by_sequence.values()) for f in (lambda r: r.length, lambda r: r.loss_tokens, lambda r: 1))
        assert tokens == limits.tokens and (not share or loss == limits.loss) and (limits.segments > 3 or count == limits.segments)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(96, 4, 40)])
def test_packing_conversations(spark, limits, monkeypatch):
    monkeypatch.setattr(packing, "TURNS", 5)
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    by_conv, by_sequence, ids, loss = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    rows = sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.text))
    for r, own in zip(rows, library_ids([r.text for r in rows])):
        own = [*own, 2]
        ids[r.conv_id] += own
        loss[r.conv_id] += [r.role == "assistant"] * len(own)
    for r in packing.pack_conversations(turns, WORDS, 2, limits).collect():
        by_conv[r.conv_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_conv) == set(ids)
    for i, pieces in by_conv.items():
        at, own = 0, np.array(ids[i], "<u4")
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(own[at:at + r.length].tobytes()) and r.loss_tokens == sum(loss[i][at:at + r.length])
            at += r.length
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and sum(r.segments for r in pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss
    if limits.tokens < 2048:  # all three limits are reached
        assert {max(sum(getattr(r, c) for r in p) for p in by_sequence.values()) for c in ("length", "segments", "loss_tokens")} == {96, 4, 40}
    odd = spark.createDataFrame([(None, 1, None, None), (1, 1, "assistant", "a b"), (1, 1, "user", "a"), (2, None, "user", "")], "conv_id long, turn int, role string, text string")
    got = packing.pack_conversations(odd, WORDS, 2).collect()
    assert {(r.conv_id, r.start, r.length) for r in got} and sum(r.length for r in got) == 7
    assert packing.pack_conversations(odd.limit(0), WORDS, 2).count() == 0


def test_packing_bears_odd_rows(odd, none):
    got = packing.pack(odd, WORDS, 1).collect()
    assert sorted(r.length for r in got if r.doc_id in (3, 4, 7)) == [1, 1, 1]
    assert sum(r.length for r in got if r.doc_id == 2) == 2 * next(r.doc_tokens for r in got if r.doc_id == 2)
    assert packing.pack(none, WORDS, 1).count() == 0


@pytest.mark.parametrize("n, kind", [(1, "even"), (5, "even"), (4097, "zipf"), (20_000, "zipf"), (20_000, "loop")])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"even": lambda: rng.integers(0, 49_408, n), "zipf": lambda: np.minimum(rng.zipf(1.3, n), 49_407), "loop": lambda: np.arange(n) % 50}[kind]().astype(np.int64)
    freq = mixing.Frequencies.from_bytes(mixing.Frequencies.count(ids).to_bytes())
    payloads = mixing.encode(ids, freq)
    assert (mixing.decode(payloads, n, freq) == ids).all()
    if kind == "loop":  # orders 1 and 2 know it all
        assert sum(map(len, payloads)) * 8 / n < 1


@pytest.mark.parametrize("chars, group", [(20_000_000, tokenfile.GROUP), (60_000, tokenfile.GROUP), (400_000, 6 * mixing.BLOCK)])
def test_token_files_hold_all_ids_in_order(docs, chars, group, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_CHARS", chars)
    monkeypatch.setattr(tokenfile, "GROUP", group)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got, at = {r.doc_id: r for r in tokenfile.round_trip(docs, WORDS, 2).collect()}, 0
    for r, ids in zip(rows, library_ids([r.text for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        assert tuple(got[r.doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_a_repeated_id_shares_out_over_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_CHARS", 4000)
    texts = [f"text number {i % 40} of one id" for i in range(900)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(8, "last")], "doc_id long, text string").repartition(5)
    got = sorted(tokenfile.round_trip(docs, WORDS, 2).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]] and got[-1].doc_id == 8
    want = sorted(zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for ids in library_ids([*texts, "last"]))
    assert sorted(r.ids_crc32 for r in got) == want


def test_token_file_checksum(docs, spark, tmp_path):
    (uri, *rest), = tokenfile.write(docs.limit(20), WORDS, 2, f"file://{tmp_path}")
    path = uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 3] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        tokenfile.read(spark, [(uri, *rest)]).collect()


def test_token_file_bears_odd_rows(odd, none):
    got = sorted(tokenfile.round_trip(odd, WORDS, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
    assert got[4].n_tokens == 1 and got[2].ids_crc32 == got[3].ids_crc32
    assert tokenfile.round_trip(none, WORDS, 2).count() == 0
