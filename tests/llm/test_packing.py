from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm import brute
from vitrine.llm import packing, queries, stages
from vitrine.llm.shared import table

PATH = stages.tokenizer("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["Word,", "don't", " ", "\n", "é", "É!", "ΣΑΣ", "İ", "<|endoftext|>", "́", "　", "\x1c", "ß"]), st.text(max_size=4)), max_size=8).map("".join))
def test_encoder(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(packing.encoder(PATH)([text])[0], dtype="<u4").tolist() == by_library(text)


def test_forgetting_changes_nothing():
    encode = packing.Encoder(PATH, remember=10)
    for i in range(40):
        text = f"Some words{i}, and more{i}! " + "x" * i * 3
        assert np.frombuffer(encode([text, None])[0], dtype="<u4").tolist() == by_library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_tournament(sizes):
    where, offset = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 20)
    expected = brute.first_fit(sizes, 20)
    assert {i: (int(where[i]), int(offset[i])) for i in range(len(sizes))} == expected


def check(rows):
    bins = defaultdict(list)
    for row in rows:
        bins[row["sequence_id"]].append((row["offset"], row["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return [sum(n for _, n in pieces) for pieces in bins.values()]


def test_query(workers):
    docs = {r["doc_id"]: r["text"] for r in table(workers, DATA, "documents").collect()}
    rows = queries.QUERIES["op6_first_fit_decreasing"](workers, DATA).collect()
    fills = check(rows)
    assert sum(2048 - n for n in fills if n & (n - 1)) <= 0.02 * sum(fills)
    pieces = defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
    assert set(pieces) == set(docs)
    for doc, own in pieces.items():
        ids = np.array([*by_library(docs[doc]), 1], dtype="<u4")
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["doc_tokens"] == len(ids)


def test_round_trip(workers):
    docs = table(workers, DATA, "documents").limit(40)
    cut = packing.pieces(docs, PATH, keep=("doc_id",))
    packed = packing.pack(cut, ("doc_id", "start"))
    held = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4") for r in packing.sequences(packed).collect()}
    back = defaultdict(dict)
    for r in packed.collect():
        back[r["doc_id"]][r["start"]] = held[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    for doc in docs.collect():
        parts = back[doc["doc_id"]]
        assert np.concatenate([parts[s] for s in sorted(parts)]).tolist() == [*by_library(doc["text"]), 1]


def test_messy(messy, nothing):
    packed = stages.pack_documents(messy)
    rows = packed.collect()
    check(rows)
    assert sum(r["length"] for r in rows) == sum(len(by_library(r["text"])) + 1 for r in messy.collect())
    assert stages.pack_documents(nothing).count() == 0
