from __future__ import annotations

import random
import re

import pytest

from tests.conftest import DATA
from tests.llm import brute
from vitrine.llm import licenses, queries
from vitrine.llm.shared import table


def expected(text):
    words = brute.license_words(text)
    found = [(p, label) for phrase, label in licenses.BASE for p in brute.places(words, phrase)]
    starts = [p for p, _ in found]
    return {
        "n_words": len(words),
        "n_base": len(found),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({label for _, label in found})),
    }


def kept(text):
    """Detections after suppression, by plain loops."""
    words = brute.license_words(text)
    spaced = f" {' '.join(words)} "
    found = set()
    for rank, rule in enumerate(licenses.rules()):
        for match in re.finditer(rf"(?<= ){rule.pattern}(?= )", spaced):
            start = spaced[: match.start()].count(" ") - 1
            found.add((start, -(start + match[0].count(" ") + 1), rank, rule.label))
    out = []
    for start, back, rank, label in sorted(found):
        if out and -back <= -out[-1][1]:
            continue
        if out and start < -out[-1][1]:
            if rank < out[-1][2]:
                out[-1] = (start, back, rank, label)
            continue
        out.append((start, back, rank, label))
    return [(start, -back, label) for start, back, _, label in out]


def test_rules():
    rules = licenses.rules()
    assert len(rules) >= 200
    for rule in rules:
        re.compile(rule.pattern)
        assert 0 < rule.trust <= 1
        assert not rule.pattern.startswith(" ") and not rule.pattern.endswith(" ")


def test_every_sentence_is_found():
    """A sentence holds its keyword, in normal form, and its own text has its label."""
    for label, keyword, pattern in licenses.SENTENCES:
        assert keyword == " ".join(brute.license_words(keyword))
        # Texts as written, with and without optional parts; lookaheads spelled out, names of one word.
        spelled = re.sub(r"\(\?=([^()]*)\)", r"\1", pattern)
        spelled = re.sub(r"\(\?: \[\^ \]\+\)\{0,8\}\?", "", spelled)
        spelled = re.sub(r"\.\{1,\d\d\}\?|\[\^ \]\+", "someone", spelled)
        spelled = re.sub(r"\[(.)[^]]*\]", r"\1", spelled)
        bare = spelled
        while "(?:" in bare:  # inner groups first
            bare = re.sub(r"\(\?:[^()]*\)\?", "", bare)
            bare = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?!\?)", r"\1", bare)
        while "(?:" in spelled:
            spelled = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", spelled)
        for text in {bare, spelled}:
            text = text.replace("?", "").strip()
            assert keyword in text, (keyword, text)
            assert re.search(rf"(?<= ){pattern}(?= )", f" {text} "), text
    written = len(licenses.PHRASES) + len(licenses.SENTENCES) + len(licenses.SPDX)
    assert written >= 200


def test_query(workers):
    docs = {r["doc_id"]: r["text"] for r in table(workers, DATA, "documents").collect()}
    rows = queries.QUERIES["op7_license_signatures"](workers, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for row in rows:
        own = expected(docs[row["doc_id"]])
        assert {k: row[k] for k in own} == own
        labels = {label for _, _, label in kept(docs[row["doc_id"]])} | set(own["base_labels"].split(","))
        assert row["labels"] == ",".join(sorted(labels - {""}))
        assert 0 <= row["score"] <= 1


SPELLINGS = [
    ("under GPLv3.", ["gpl-3"]),
    ("under GPLv2+ or so", ["gpl-2"]),
    ("GNU GPL version 3 or any later version", ["gpl-3"]),
    ("LGPLv2.1", ["lgpl-2.1"]),
    ("LGPLv2+", ["lgpl-2"]),
    ("(AGPLv3)", ["agpl-3"]),
    ("GPL v2", ["gpl-2"]),
    ("GPL-3.0-only", ["gpl-3.0"]),
    ("MPLv2.0", ["mpl-2.0"]),
    ("You may not use this file except in compliance with the License.", ["apache"]),
    ("altered source versions must be plainly marked as such, and must not be\n misrepresented as being the original software", ["zlib"]),
    ("gplus and eclair, mplayer 2", []),
    ("// SPDX-License-Identifier: MIT", ["mit"]),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
    ("SPDX-License-Identifier: ISC */", ["isc"]),
    ("SPDX-License-Identifier: LGPL-2.1-only", ["lgpl-2.1"]),
    ("SPDX-License-Identifier: Nothing-1.0", []),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", ["apache-2.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 licence", ["creative-commons", "cc-by-4.0"]),
    ("under the Apache License v2.0 with LLVM Exceptions.", ["apache-2.0", "llvm-exception"]),
    ("under the terms of the GNU Free Documentation License, Version 1.3", ["gfdl-1.3"]),
    ("This software is based in part on the work of the Independent JPEG Group.", ["ijg"]),
    ("The Software shall be used for Good, not Evil.", ["json"]),
    ("If you create a document which uses this font", []),
]


def test_spellings(workers):
    frame = workers.createDataFrame([(text,) for text, _ in SPELLINGS], "text string")
    found = licenses.scan(frame, keep=("text",)).collect()
    assert {r["text"]: [d["label"] for d in r["detections"]] for r in found} == dict(SPELLINGS)


PARTS = """MIT License|mit-license|Apache License, Version 2.0|the GNU General Public License v3 or later|GPL|
gnu general public license|cc by|CC-BY-SA 4.0|cc by nc nd|creative commons attribution|mozilla public license|
apache|license|or any later version|version|2.0|3|BSD 3-Clause License|copyright 2020|all rights reserved|
permission is hereby granted, free of charge, to any person obtaining a copy|ñandú|İ|K|x|under the|lgpl 2.1 only|
neither the name of X nor the names of its contributors may be used to endorse""".replace("\n", "").split("|")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    return [" ".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(250)]


def test_against_loops(workers, texts):
    rows = workers.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in licenses.scan(rows, keep=("doc_id", "text")).collect():
        own = expected(row["text"])
        assert row["n_words"] == own["n_words"] and len(row["base"]) == own["n_base"]
        assert sorted({b["label"] for b in row["base"]}) == [x for x in own["base_labels"].split(",") if x]
        assert [(d["start"], d["end"], d["label"]) for d in row["detections"]] == kept(row["text"]), row["text"]


def test_messy(messy, nothing):
    for row in licenses.scan(messy, keep=("doc_id", "text", "spaced", "size")).collect():
        own = expected(row["text"])
        assert row["n_words"] == own["n_words"] and len(row["base"]) == own["n_base"]
    assert licenses.scan(nothing).count() == 0


def test_plan_is_native(workers):
    frame = queries.QUERIES["op7_license_signatures"](workers, DATA)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
