"""Token alignment against the tokenizers themselves."""

from __future__ import annotations

from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm import brute
from vitrine.llm import alignment, queries, stages
from vitrine.llm.shared import byte_letters, table

A, B = stages.tokenizer("byte_bpe_50k.json"), stages.tokenizer("piece_bpe_32k.model")
PARTS = ["a", "don't", " ", "  ", "\n", "\t", "é", "中文", "12", "!", "...", "<|endoftext|>", "<s>", "<0x41>"]
PARTS += ["　", "\x85", "\x1c", "\x00", "😀", "\r\n", "́", "ﬁ", "▁", " ▁", "\u088f", "\U0003d000're", "aaaaaaaaaaaa"]


@lru_cache
def libraries():
    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = {letter: byte for byte, letter in byte_letters().items()}

    def by_one(text):
        ids = one.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in ids]

    def piece(i):
        text = two.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if two.is_byte(i) else text.replace("▁", " ").encode()

    return by_one, lambda text: [(i, piece(i)) for i in two.encode(text, num_threads=1)]


def encoders():
    return lambda: alignment.byte_level(A), lambda: alignment.sentence_pieces(B)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), min_size=1, max_size=12).map("".join))
def test_tokens_are_those_of_the_libraries(text):
    text = text.encode("utf-8", "ignore").decode()
    if text:
        by_one, by_two = libraries()
        assert alignment.byte_level(A)([" " + text]).to_pylist()[0] == [i for i, _ in by_one(text)]
        if "▁" not in text:
            assert alignment.sentence_pieces(B)([" " + text]).to_pylist()[0] == [i for i, _ in by_two(text)]


def found(frame, keep=("doc_id",)):
    return alignment.alignment(frame, *encoders(), keep=keep)


def test_against_the_libraries(workers):
    texts = [None, "", "▁ a piece mark", "aaaa " * 300, *PARTS, *(f"word {i % 7} and {i % 11}-ing" for i in range(80))]
    rows = [(i % 90 if i % 13 else None, text) for i, text in enumerate(texts)]
    key = lambda r: tuple(str(x) for x in r)
    expected = sorted(brute.aligned(rows, *libraries()), key=key)
    frame = workers.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Whatever is aligned at once and counted together, the result is the same.
    for sizes in ((1 << 20, 8 << 20), (300, 2000), (1, 1)):
        got = alignment.alignment(frame, *encoders(), sizes=sizes)
        assert sorted(map(tuple, got.collect()), key=key) == expected


def test_query(workers):
    rows = [(r["doc_id"], r["text"]) for r in table(workers, DATA, "documents").collect()]
    got = queries.QUERIES["op13_aligned_tokens"](workers, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(brute.aligned(rows, *libraries()))


def test_messy(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = found(messy, ("doc_id", "score", "part")).drop("score", "part").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute.aligned(rows, *libraries()), key=key)
    assert found(nothing).count() == 0


def test_a_known_piece_is_looked_up_once():
    class Piece(str):
        hashed = 0

        def __hash__(self):
            Piece.hashed += 1
            return str.__hash__(self)

    def encode(pieces):
        if "!" in pieces:
            raise ValueError("not to be encoded")
        return [[ord(piece)] for piece in pieces]

    encoder = alignment.Encoder(lambda text: [Piece(c) for c in text], encode, [bytes([n]) for n in range(128)])
    texts, want = ["abca", "", "b"], [[97, 98, 99, 97], [], [98]]
    assert encoder(texts).to_pylist() == want
    Piece.hashed = 0
    assert encoder(texts).to_pylist() == want
    assert Piece.hashed == 5
    # pieces that could not be encoded leave nothing behind
    with pytest.raises(ValueError):
        encoder(["xa!b"])
    assert encoder(["xb", "a"]).to_pylist() == [[120, 98], [97]]
