import random

import public_tokenizers
import pytest
import sentencepiece

from pitspark.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"ab  \n\t▁éñ執벨😀​　<s>/0x1.,;\x00ßÄ", "the", "in", "ing", "   ", "<0x0A>", "</s>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_proof_holds_in_the_library(library):
    counter = token_counts.PieceCounter(MODEL)
    for piece in random.Random(0).sample(sorted(counter.whole), 3000):
        # the mark stands before a text in any case
        if piece.startswith("▁") and piece.strip("▁"):
            assert library.encode(piece[1:].replace("▁", " "), out_type=str) == [piece]
    again = token_counts.PieceCounter(MODEL, counter.proof())
    assert again.whole == counter.whole


def test_a_piece_that_does_not_encode_alone_is_merged():
    counter = token_counts.PieceCounter(MODEL)
    counter.rank = {"a": 9.0, "b": 9.0, "c": 9.0, "d": 9.0, "bc": 1.0, "ab": 2.0, "cd": 2.0, "abcd": 0.5}
    assert [counter.merged(x) for x in ("ab", "cd", "abcd", "éab")] == [1, 1, 3, 3]


def test_counts_of_random_texts_are_the_librarys(library, monkeypatch):
    counter, rng = token_counts.PieceCounter(MODEL), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert [counter.count(x) for x in texts] == [len(x) for x in library.encode(texts)]
    monkeypatch.setattr(token_counts, "WINDOW", 5)
    monkeypatch.setattr(token_counts, "SHORT", 3)
    counter.memo.clear()
    assert [counter.count(x) for x in texts[:500]] == [len(x) for x in library.encode(texts[:500])]


def test_long_texts(library):
    counter = token_counts.PieceCounter(MODEL)
    for text in ("ab" * 200_000, "word " * 300_000, " " * 300_000, "x\n" * 150_000, "執" * 100_000):
        assert counter.count(text) == len(library.encode(text))


def test_every_row_has_its_count(spark, docs, library):
    texts = [None, "", " ", "It is so.", "It is so.", "é" * 5000, "no blanks" * 2000]
    rows = docs([(None if i == 3 else i // 2, t, "s") for i, t in enumerate(texts)])
    got = sorted(tuple(r) for r in token_counts.token_counts(rows.withColumnRenamed("source", "n_tokens"), MODEL).fillna(-1).collect())
    want = sorted((-1 if i == 3 else i // 2, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in enumerate(texts))
    assert got == want
    assert token_counts.token_counts(docs([]), MODEL).count() == 0
