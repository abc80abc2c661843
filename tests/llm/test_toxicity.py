from __future__ import annotations

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import queries, stages, toxicity
from vitrine.llm.shared import table

FOLDER = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


TERMS = {"idiot": 2.0, "worthless": 3.0, "clown": 1.0, "scum": 5.0, "crown": 1.5}


@settings(max_examples=400, deadline=None)
@given(
    st.sampled_from(sorted(TERMS)),
    st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["add", "drop", "change"]), st.sampled_from("abciorw0")), max_size=2),
)
def test_automaton(term, edits):
    lexicon = toxicity.Lexicon(TERMS, {})
    word = term
    for at, kind, letter in edits:
        at = min(at, len(word))
        tail = word[at:] if kind == "add" else word[at + 1 :]
        word = word[:at] + ("" if kind == "drop" else letter) + tail
    near = [w for t, w in TERMS.items() if len(t) >= toxicity.FUZZY_FROM and distance(t, word) <= 1]
    expected = (
        (toxicity.EXACT, TERMS[word]) if word in TERMS else (toxicity.NEAR, max(near)) if near else None
    )
    assert lexicon.match(word) == expected


def test_context():
    reader = toxicity.Reader(toxicity.Lexicon(TERMS, {"lostra": 4.0}))
    abuse = reader.features("you are an idiot, lostraschaft")
    quoted = reader.features('they wrote "an idiot" on it, and "lostraschaft"')
    assert abuse[0] > 0 and abuse[1] == 0 and quoted[0] == 0 and quoted[1] > 0
    assert abuse[2] > quoted[2]
    assert abuse[3] > 0 and abuse[4] > 0 and abuse[5] == 0
    assert reader.features("an idoit is no match, an idiott is")[5] > 0
    assert reader.features(None) == reader.features("") == [0.0] * toxicity.N_FEATURES


def test_held_out(workers):
    labels = {r["doc_id"]: r["toxic"] for r in table(workers, FOLDER, "labels").collect()}
    rows = queries.QUERIES["op5_lexicon_toxicity"](workers, FOLDER).collect()
    tested = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for y, p in tested if y == 1]
    clean = [p for y, p in tested if y == 0]
    assert sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_messy(workers, messy, nothing):
    labels = workers.createDataFrame(
        [(1, 1, 1), (2, 1, 1), (6, 0, 0), (7, 0, 0), (None, 0, 1), (8, 0, None), (1, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    for given_labels in (labels, labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.fit(messy, given_labels)
        rows = toxicity.with_scores(messy, model).collect()
        assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.fit(nothing, labels)
    assert toxicity.with_scores(nothing, model).count() == 0
    kept = stages.reject_toxic(messy, labels.limit(0))
    assert kept.columns == messy.columns and kept.count() == messy.count()


def test_copies_teach_nothing(workers):
    """A text that was copied often speaks for itself only."""
    rows = [(i, "common words here and there " + " ".join(f"w{i * 7 + k}" for k in range(9)), 0) for i in range(200)]
    rows += [(1000 + i, "copied lines of one peculiar text", 1) for i in range(30)]
    rows += [(2000 + i, f"w{i} moron w{i * 3} and w{i + 5}", 1) for i in range(30)]
    texts = workers.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    lexicon = toxicity.learn_lexicon(texts)
    assert set(lexicon.terms) == {"moron"}


def test_repeated_ids_are_learned_from_once(workers):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:4]
    rows = [(ids[0], f"copy {i}") for i in range(200)] + [(i, f"text {i}") for i in ids[1:]]
    docs = workers.createDataFrame(rows, "doc_id long, text string")
    labels = workers.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    found = toxicity.training_rows(docs, labels, sample=4).collect()
    again = toxicity.training_rows(docs.repartition(7), labels, sample=4).collect()
    assert len(found) == 4 and sorted(found) == sorted(again)
