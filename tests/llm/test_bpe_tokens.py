import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from foldwright.llm import bpe, tokens


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_on_random_texts(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 16)
    c, rnd = bpe.Codec(*bpe.default_vocabulary()), random.Random(1)
    parts = ["abcdefgh", "aab ", " \n\t\x1c\x85　a1'st", "éàñ漢字😀 x", "0123456789 .,!?'re", "the quick brown fox ", "​́a \x1f\x00"]
    for _ in range(1500):
        s = "".join(rnd.choice(rnd.choice(parts)) for _ in range(rnd.randint(0, 150)))
        ids = c.encode(s)
        assert ids == np.array(reference.encode_ordinary(s), "<u4").tobytes(), repr(s)
        assert c.decode(ids) == s.encode()


@pytest.mark.parametrize("s", ["a" * 20000, "ab" * 9000, " " * 30000, "x y" * 9000, "\n \n" * 9000 + "a", "Zq" * 5 + "é" * 9000])
def test_bpe_long_runs(reference, s):
    assert bpe.codec(*bpe.default_vocabulary()).encode(s) == np.array(reference.encode_ordinary(s), "<u4").tobytes()


def test_bpe_query(spark, small, edge, empty, reference, monkeypatch):
    for df in (small, edge, empty):
        monkeypatch.setattr(bpe, "table", lambda *a, d=df: d)
        got = sorted(map(tuple, bpe.op6_byte_bpe(spark, "").collect()), key=repr)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = reference.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_bpe_operators_round_trip(edge):
    back = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(bpe.encode(edge)).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in edge.collect()}


def test_word_pieces_equal_library():
    lib, w, rnd = Tokenizer.from_file(tokens.default_tokenizer()), tokens.WordTokens(tokens.default_tokenizer()), random.Random(3)
    parts = ["abc 'st", "  \t\n\x0b", "éÀñΣς̈ ́", "123 .,!", "　\x85  x", ["<|endoftext|>"], "漢字😀", ["Word,", "WORD!!", "en%%%", "isn't."]]
    for k in range(2500):
        s = " ".join(rnd.choice(rnd.choice(parts)) for _ in range(8)) if k % 2 else "".join(rnd.choice(rnd.choice(parts)) for _ in range(30))
        assert np.frombuffer(w.encode(s), "<u4").tolist() == lib.encode(s, add_special_tokens=False).ids, repr(s)


def test_stream_coding_round_trip():
    g = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        v = (g.integers(0, 2**32, n) >> g.integers(0, 32, n)).astype(np.uint32)
        c, d = tokens.pack(v)
        assert len(c) == -(-n // 4) and (tokens.unpack(c, d, n) == v).all()


def test_token_files(spark, small, edge, empty, monkeypatch):
    lib = Tokenizer.from_file(tokens.default_tokenizer())
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 500)
    for df in (small, edge, empty):
        monkeypatch.setattr(tokens, "table", lambda *a, d=df: d)
        got = sorted(map(tuple, tokens.op2_token_files(spark, "").collect()), key=lambda r: r[1])
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        at = 0
        for doc, start, n, crc in got:
            ids = [*lib.encode(texts[doc], add_special_tokens=False).ids, 2]
            assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += n
        ids = [r[0] for r in got]
        assert len(got) == df.count() and ids == sorted(ids, key=lambda x: (x is not None, x))
