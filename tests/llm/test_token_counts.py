from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from vitrine.llm import queries, stages, token_counts
from vitrine.llm.shared import table

PATH = stages.tokenizer("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "don", "'re", "'ll", "'s", "'", " ", "  ", "\n", "\t", "é", "ß", "中", "12", "!", "..."]
PARTS += ["\u088f", "\U0003d000", "\u0558"]
PARTS += ["<|endoftext|>", "<|endof", "　", "\x85", "\x1c", "\x00", "😀", "\r\n", "́", "İ"]


def by_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=10).map("".join))
def test_every_prefix(text):
    text = text.encode("utf-8", "ignore").decode()
    got = token_counts.counter(PATH)([text])[0].tolist()
    assert got == [by_library(text[:i]) for i in range(1, len(text) + 1)]


def test_cut_of_every_code_point():
    """Between a letter, a number and a sign, each code point is cut as the library cuts it."""
    cut = token_counts.Cutter(PATH)
    odd, settled = token_counts.disputed(), token_counts.regex.compile(f"[{token_counts.SETTLED}]")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    disputed = [c for c in points if odd and odd.match(c)]
    assert not any(map(settled.match, disputed))
    agreed = sorted(set(points).difference(disputed))
    for kind in (agreed, disputed[::16]):
        for start in range(0, len(kind), 4096):
            text = "".join(f"a{c}1{c}. " for c in kind[start : start + 4096])
            assert cut(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("text", ["\U0003d000're", "\u0558're", "a\u088f", "\u0c5c1", "x\U00011de0 1", "\ua7ce's"])
def test_newer_letters(text):
    got = token_counts.counter(PATH)([text])[0].tolist()
    assert got == [by_library(text[:i]) for i in range(1, len(text) + 1)]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} and more, words {i}" for i in range(300)]
    for name in ("PIECES", "PAIRS"):
        monkeypatch.setattr(token_counts, name, 20)
    counter = token_counts.PrefixCounter(PATH)
    assert [int(counter([t])[0][-1]) for t in texts] == [by_library(t) for t in texts]


def test_query(workers):
    docs = {r["doc_id"]: r["text"] for r in table(workers, DATA, "documents").collect()}
    rows = queries.QUERIES["op2_prefix_token_counts"](workers, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for row in rows:
        text = docs[row["doc_id"]]
        assert row["n_tokens"] == by_library(text)
        assert row["tokens_in_1000_chars"] == by_library(text[:1000])
        assert row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 1024)


def test_messy(messy, nothing):
    rows = token_counts.prefix_counts(messy, PATH, keep=("doc_id", "text", "score"))
    for row in rows.collect():
        text = row["text"] or ""
        assert len(row["prefix_tokens"]) == len(text)
        assert not text or row["prefix_tokens"][-1] == by_library(text)
    assert token_counts.prefix_counts(nothing, PATH).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 5, 1000])
def test_budget(workers, budget):
    text = "Words that  don't fit, in 12 tokens"
    rows = workers.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    counted = token_counts.prefix_counts(rows, PATH)
    row = counted.filter("doc_id = 1").select(
        token_counts.fits_in(F.col("prefix_tokens"), budget).alias("fits"),
        token_counts.tokens_in(F.col("prefix_tokens"), F.lit(7)).alias("seven"),
    )
    found = row.first()
    assert found["fits"] == max([0, *(i for i in range(len(text) + 1) if by_library(text[:i]) <= budget)])
    assert found["seven"] == by_library(text[:7])
    assert counted.filter("doc_id = 2").select(
        token_counts.fits_in(F.col("prefix_tokens"), budget)
    ).first()[0] == 0
