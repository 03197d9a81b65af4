import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from lintlake.llm import pfor, tokens, vector_packing
from lintlake.llm.tokens import Encoder
from lintlake.llm.vector_packing import Limits, loss_in, pack

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_ids_of_whole_texts(library, corpus):
    encode = Encoder(VOCABULARY)
    assert encode.by_piece
    odd = ["", " ", "  \n\n x", "it's we'll 'sx ''s I'D", "a b c　 d", "\x00\x1c\x1f\x85 \x7f", "٣٤ ²½ ⅷ", "é ‍👩‍👩 <|endoftext|> x", "x" * 3000, "\r\n\t a\t\tb"]
    odd += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in [*range(0x20, 0x2FF, 7), *range(0x600, 0xD7FF, 97), *range(0xE000, 0x1FFFF, 213)]]
    texts = [*odd, *corpus.values(), None]
    ids, first = encode(texts)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library(t), repr(t)[:80]


def test_texts_are_cut_together_as_the_pattern_cuts_each(monkeypatch):
    cut_each = regex.compile(tokens.PIECES).findall
    rng = np.random.default_rng(3)
    signs = list("  \t\n'" + "''srtevmldxAZ09.,-é２\u3000\u00a0²٣\x1c\x85\u200d👩ſ")
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 12)))) for _ in range(4000)]
    joined, offsets = "".join(texts), np.cumsum([0, *(len(t.encode()) for t in texts)])
    data = joined.encode()
    begin = tokens.cut(joined, np.frombuffer(data, np.uint8), offsets).tolist()
    got = [data[a:b].decode() for a, b in zip(begin, [*begin[1:], len(data)], strict=True)]
    assert got == [p for t in texts for p in cut_each(t)]
    encode, asked = Encoder(VOCABULARY), []
    kind = type(encode.pieces)
    number = kind.__getitem__
    monkeypatch.setattr(kind, "__getitem__", lambda self, piece: (asked.append(piece), number(self, piece))[1], raising=False)
    encode(["many equal words " * 5000] * 3)
    assert 0 < len(asked) < 10  # a piece is looked up once a chunk, not at each of its places


def test_added_tokens_are_those_of_the_unchanged_library(spark, docs_of):
    default = Tokenizer.from_file(VOCABULARY)
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", "plain", mark, f"{mark}{mark}", None, f"x\n{mark}  y {mark[:-1]}", "<|endoftext", f"end {mark}", "plain"]
    want = [[*default.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    ids, first = Encoder(VOCABULARY, added=True)(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
    rows = vector_packing.pack_documents(docs_of(dict(enumerate(texts))), VOCABULARY).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(w), crc(w)) for i, w in enumerate(want)}


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Encoder(path)
    assert not encode.by_piece
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids, first = encode(["Hello there", None, "x"], None)
    assert ids[: first[1]].tolist() == t.encode("Hello there", add_special_tokens=False).ids and first[1] == first[2]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_shards_come_back(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.integers(7, 8, n), np.where(rng.random(n) < 0.05, 4_000_000_000, rng.integers(100, 200, n)), np.arange(n) * 3):
        ids = ids.astype(np.uint32)
        data = pfor.encode(ids)
        assert pfor.decode(data).tolist() == ids.tolist()
        for lo, hi in ((0, 10), (n // 2, n // 2 + 300), (n - 1, n), (n, n)):
            lo = max(lo, 0)
            assert pfor.decode(data, lo, hi).tolist() == ids[lo:hi].tolist()


def test_outliers_go_to_exceptions():
    ids = np.full(2560, 1000, np.uint32) + np.arange(2560, dtype=np.uint32) % 16
    plain = len(pfor.encode(ids))
    ids[::256] = 50_000
    assert len(pfor.encode(ids)) <= plain + 5 * 10


def test_query_equals_the_library(spark, corpus, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in pfor.query(spark, SF).collect()}
    start = 0
    for k, t in sorted(corpus.items()):
        ids = library(t)
        assert got[k] == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(corpus)


def test_token_files_edge_cases(spark, docs_of, library, tmp_path):
    rows = [(3, "b c"), (1, None), (1, None), (None, "x"), (2, ""), (9, "word " * 60_000)]
    pfor.write_tokens(docs_of(rows, id="int", range="int", shard="string"), VOCABULARY, str(tmp_path / "t"), 50)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in pfor.read_tokens(spark, str(tmp_path / "t")).collect())
    start, want = 0, []
    for k, t in [(None, "x"), (1, None), (1, None), (2, ""), (3, "b c"), (9, "word " * 60_000)]:
        ids = library(t)
        want.append((start, k, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    pfor.write_tokens(docs_of({}), VOCABULARY, str(tmp_path / "e"))
    assert pfor.read_tokens(spark, str(tmp_path / "e")).collect() == []


def check_pieces(rows, ids_of, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for k, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length]) and r.length > 0
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        total += limits.tokens - at
    return total


def test_packing_query(spark, corpus, library):
    rows = vector_packing.query(spark, SF).collect()
    ids_of = {k: library(t) for k, t in corpus.items()}
    assert check_pieces(rows, ids_of, Limits()) <= 1024


def test_packing_edge_cases(spark, docs_of, library):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "word " * 5000), *[(100 + i, "x") for i in range(300)]]
    limits = Limits(64, 5, 40)
    found = vector_packing.pack_documents(docs_of(rows, part="int", loss="int"), VOCABULARY, limits).collect()
    check_pieces(found, {k: library(t) for k, t in rows}, limits)
    twice = vector_packing.pack_documents(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), VOCABULARY).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 3), (1, 3)]
    assert vector_packing.pack_documents(docs_of({}), VOCABULARY).collect() == []


def test_rests_that_demand_the_same_are_weighed_once(monkeypatch):
    weighed = []
    where = np.where
    monkeypatch.setattr(np, "where", lambda c, *rest: (weighed.append(np.size(c)), where(c, *rest))[1])
    sizes = np.arange(6000) % 50 + 1
    pieces = pack(sizes, np.zeros(6000, np.int64), Limits())
    assert np.bincount(pieces[:, 0], pieces[:, 2], 6000).tolist() == sizes.tolist()
    assert np.bincount(pieces[:, 3], pieces[:, 2]).max() <= 1024 and np.bincount(pieces[:, 3]).max() <= 128
    assert 0 < sum(weighed) < 1000 * 6000  # 36 million, when each step weighed every document


@pytest.mark.parametrize("seed", range(5))
def test_three_limits_hold_together(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 300, 200)
    loss_from = np.where(rng.random(200) < 0.5, 0, (sizes * rng.random(200)).astype(np.int64))
    limits = Limits(256, 6, 200)
    pieces = pack(sizes, loss_from, limits)
    assert np.bincount(pieces[:, 0], pieces[:, 2], 200).tolist() == sizes.tolist()
    loss = loss_in(pieces[:, 1], pieces[:, 2], loss_from[pieces[:, 0]])
    used = [np.bincount(pieces[:, 3], w) for w in (pieces[:, 2], np.ones(len(pieces)), loss)]
    assert used[0].max() <= 256 and used[1].max() <= 6 and used[2].max() <= 200
    bound = max(-(-sizes.sum() // 256), -(-int(loss.sum()) // 200))
    assert len(used[0]) <= 1.25 * bound + 2


def test_loss_share_of_documents(docs_of):
    from pyspark.sql import functions as F

    rows = vector_packing.pack_documents(docs_of([(1, "a b c d"), (2, "e f")]).coalesce(1), VOCABULARY, loss=F.lit(2)).collect()
    assert len({r.sequence_id for r in rows}) == 1
