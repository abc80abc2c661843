"""Deep-shallow sorting and removal of repeated passages against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from tests.llm import brute
from vitrine.llm import deep_shallow, queries, repeats
from vitrine.llm.shared import table

SHOWN = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def found(frame, name="doc_id", **how):
    rows = repeats.removed_passages(frame, identity=name, **how).select(name, *SHOWN).collect()
    return sorted((brute.number(r[0]), *r[1:]) for r in rows)


def expected(rows, length=50):
    return sorted((brute.number(r[0]), *r[1:]) for r in brute.removed_passages(rows, length))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.lists(st.sampled_from([0, 1, 255]), min_size=20, max_size=20)),
        min_size=1,
        max_size=40,
    )
)
def test_suffix_array(rows):
    keys = np.array([key for key, _ in rows], dtype=np.uint64)
    letters = np.array([x for _, x in rows], dtype=np.uint8)
    order, common = deep_shallow.suffix_array(keys, letters)
    assert sorted(order.tolist()) == list(range(len(rows)))
    sorted_rows = [(int(keys[i]), letters[i].tolist()) for i in order]
    assert sorted_rows == sorted((key, x) for key, x in rows)
    for before, now, shared in zip([None, *sorted_rows], sorted_rows, common.tolist()):
        if before is None or before[0] != now[0]:
            assert shared == -1
        else:
            agree = [a == b for a, b in zip(before[1], now[1])]
            assert shared == (agree.index(False) if False in agree else 20)


def mixture(seed):
    """Copies, near copies, shared lines, periodic texts, NUL bytes, null ids and texts."""
    draw = random.Random(seed)
    words = ["ab", "\x00", "é", "x y", "\n", "q" * 30, "lorem", "ipsum dolor"]
    text = lambda: " ".join(draw.choice(words) + str(draw.randrange(9)) for _ in range(draw.randrange(60)))
    base = [text() for _ in range(12)] + ["a" * 400, "ab" * 300]
    base.append("a common line that all pages of this very site have at their end, always\n")
    rows = []
    for _ in range(300):
        parts = []
        for _ in range(draw.randrange(6)):
            of = draw.choice(base)
            start = draw.randrange(len(of) + 1)
            parts.append(of[start : start + draw.randrange(200)])
        made = draw.choice(base) if draw.random() < 0.2 else "".join(parts)
        rows.append((None if draw.random() < 0.03 else draw.randrange(200), None if draw.random() < 0.05 else made))
    return rows


@pytest.mark.parametrize("crowd, block", [(2000, 1 << 20), (2, 1 << 20), (5, 3000), (0, 700)])
def test_against_every_string(workers, crowd, block):
    """Whatever the blocks and however few documents make a crowd, the result is the same."""
    rows = mixture(crowd + block)
    frame = workers.createDataFrame(rows, "doc_id long, text string")
    assert found(frame, crowd=crowd, block=block, kept=False) == expected(rows)


def test_other_length_and_spans(workers):
    rows = mixture(5)[:120]
    frame = workers.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = repeats.removed_passages(frame, length=30).collect()
    assert sorted((brute.number(r["doc_id"]), *(r[n] for n in SHOWN)) for r in out) == expected(rows, 30)
    for row in out:
        spans = [(s["start"], s["end"]) for s in row["spans"]]
        assert sum(b - a for a, b in spans) == row["n_removed"]
        assert len(row["kept"]) == row["n_bytes"] - row["n_removed"]
        assert spans == sorted(spans) and all(a < b for a, b in spans)


def test_query(workers):
    rows = [(r["doc_id"], r["text"]) for r in table(workers, DATA, "documents").collect()]
    got = queries.QUERIES["op11_sorted_suffixes"](workers, DATA).collect()
    assert sorted(map(tuple, got)) == expected(rows)
    assert sum(r["n_removed"] for r in got) > 0


def test_third_of_the_rows_alike(workers):
    line = "one line of more than fifty bytes that stands on every third page of all\n"
    rows = [(i, (line if i % 3 else "") + f"own text number {i}, " * 5) for i in range(600)]
    rows += [(1000 + i, "the very same copy of one text, again and again and again") for i in range(300)]
    frame = workers.createDataFrame(rows, "doc_id long, text string")
    assert found(frame, crowd=50, block=4000, kept=False) == expected(rows)


def test_messy(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(messy) == expected(rows)
    assert repeats.removed_passages(nothing).count() == 0
    with pytest.raises(ValueError):
        repeats.removed_passages(nothing, length=20)
