import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pitspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_library(own, text):
    b = bpe.tokenizer(PATH, P.PATTERN)
    ids = b.encode(text)
    assert ids == own.encode_ordinary(text)
    assert b.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "=" * 3000, "ab" * 3000, " " * 2000, "\n" * 999, "é" * 1500, "01" * 2000, "x" * 65 + " y", "中文" * 900, "\x1c\x85 \xa0"])
def test_long_runs(own, text):
    b = bpe.tokenizer(PATH, P.PATTERN)
    assert b.encode(text) == own.encode_ordinary(text)


def test_joining_equals_encoding_the_whole():
    b = bpe.tokenizer(PATH, P.PATTERN)
    for data in (b"internationalisation", b"aaaaaaaaaaaaaaa", "größere".encode()):
        whole = b.merge(data)
        for i in range(1, len(data)):
            assert b.join(b.merge(data[:i]), b.merge(data[i:])) == whole


def test_memory_keeps_the_recent():
    m = bpe.Memo(lambda k: k * 2, 8)
    assert [m[i] for i in range(100)] == [2 * i for i in range(100)] and len(m) + len(m.old) <= 8


def test_round_trip_and_digests(docs, own):
    texts = ["Hello  world, don't!", "", None, "ünï çødé \n\n tabs\t", "hello hello", "hello hello", "w " * 5000]
    df = docs(texts)
    out = {r.doc_id: r for r in bpe.digests(bpe.bpe_decode(bpe.bpe_encode(df, PATH, P.PATTERN), PATH, P.PATTERN)).collect()}
    assert sorted(bpe.round_trip(df, PATH, P.PATTERN).collect()) == sorted(out.values())
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_encode(docs([]), PATH, P.PATTERN).count() == 0


def test_repeated_rows_and_clashing_names(docs):
    df = docs([(1, "same text", "s")] * 3 + [(None, "same text", "s"), (None, None, None)]).selectExpr("*", "1 as id", "2 as ids", "3 as decoded", "4 as n_tokens")
    rows = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 0, 1, 1, 1] and len({r.ids_sha256 for r in rows}) == 2
    assert len(bpe.bpe_decode(bpe.bpe_encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()) == 5
