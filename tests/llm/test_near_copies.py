"""Line dedup, SimHash and components against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm import brute
from vitrine.llm import line_dedup, queries, simhash, stages
from vitrine.llm.components import components
from vitrine.llm.shared import table


def plain_lines(rows, ratio, least, sure=0.0):
    pages, counts = Counter(), Counter()
    for source, text in set(rows):
        if text is not None:
            pages[source] += 1
            counts.update({(source, line.strip(" ")) for line in text.split("\n") if line.strip(" ")})
    bar = {source: ratio * n + sure * math.sqrt(ratio * n) for source, n in pages.items()}
    common = {k for k, n in counts.items() if n >= least and n > bar[k[0]]}
    out = []
    for source, text in rows:
        if text is None:
            out.append((source, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (source, x.strip(" ")) not in common]
        out.append((source, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines(workers):
    draw = random.Random(2)
    rows = []
    for i in range(300):
        source = draw.choice(["hot"] * 6 + ["a", "b", None])
        lines = [f"own {i} {k}" for k in range(draw.randint(0, 4))]
        lines += [x for x, p in (("menu", 0.5), (" menu ", 0.2), ("rare", 0.04), ("", 0.5)) if draw.random() < p]
        draw.shuffle(lines)
        rows.append((source, None if draw.random() < 0.05 else "\n".join(lines)))
    frame = workers.createDataFrame(rows, "source string, text string")
    found = line_dedup.drop_common_lines(frame, ratio=0.1, least_pages=3)
    got = Counter(tuple(r) for r in found.select("source", "text", "n_lines", "n_dropped").collect())
    assert got == Counter(plain_lines(rows, 0.1, 3))


def test_boilerplate_of_four_languages(workers):
    """Shares of languages, and of pages with their boilerplate, like those of the given sources."""
    rows = []
    for lang, pages, marked in (("en", 640, 60), ("fr", 130, 24), ("de", 130, 20), ("es", 100, 8)):
        for i in range(pages):
            lines = [f"{lang} own {i}", f"{lang} chance {i // 4}", f"{lang} menu"][: 3 if i < marked else 2]
            rows.append((len(rows), "\n".join(lines), "site", lang))
    frame = workers.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["text"] for r in stages.clean_lines(frame).collect()}
    assert got == {i: text.replace(f"\n{lang} menu", "") for i, text, _, lang in rows}


def test_clean_lines_keeps_columns_of_its_counts(workers):
    rows = [(i, f"own {i}\nmenu", "site", i + 1, f"d{i}") for i in range(6)]
    frame = workers.createDataFrame(
        rows, "doc_id long, text string, source string, n_lines int, N_Dropped string"
    )
    cleaned = stages.clean_lines(frame)
    assert cleaned.columns == frame.columns
    assert {tuple(r) for r in cleaned.collect()} == {
        (i, f"own {i}", "site", i + 1, f"d{i}") for i in range(6)
    }


def test_copies_keep_their_lines(workers):
    """Copies of one text are one page, however many there are."""
    rows = [(i, f"own {i}\nmenu", "site") for i in range(200)]
    rows += [(1000 + i, "copied one\ncopied two\nmenu", "site") for i in range(60)]
    rows += [(2000 + i, "all there is", "other") for i in range(6)]
    frame = workers.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in stages.clean_lines(frame).collect()}
    assert got == {i: text.replace("\nmenu", "") for i, text, _ in rows}


@pytest.mark.parametrize("pages, common", [(2, 3), (20, 3), (100, 3), (500, 5), (5000, 25)])
def test_bar_follows_the_site(workers, pages, common):
    """The least number of pages that makes a line common, at each size of a site."""
    rows = [
        (i, "\n".join([f"own {i}", *(f"on {n}" for n in range(1, min(30, pages) + 1) if i < n)]), "site")
        for i in range(pages)
    ]
    frame = workers.createDataFrame(rows, "doc_id long, text string, source string")
    left = "\n".join(r["text"] for r in stages.clean_lines(frame).collect()).split("\n")
    assert {x for x in left if x.startswith("on")} == {f"on {n}" for n in range(1, min(common, pages + 1))}


def test_page_lines_by_host(workers):
    rows = duckdb.sql(queries.PAGES_SQL.replace("FROM pages", f"FROM '{DATA}/pages.parquet'"))
    got = queries.page_lines(workers, DATA).select(*rows.columns).collect()
    assert Counter(map(tuple, got)) == Counter(rows.fetchall())


def test_dotted_names(workers):
    rows = [(i, f"own {i}\nmenu", "site", i) for i in range(9)]
    frame = workers.createDataFrame(rows, "doc_id long, text string, source string, `la.ng` int")
    assert stages.clean_lines(frame).columns == frame.columns
    assert {r["la.ng"] for r in stages.take_mix(frame).collect()} <= set(range(9))


def test_lines_of_messy(messy, nothing):
    found = line_dedup.drop_common_lines(messy, least_pages=2)
    assert found.count() == messy.count()
    assert line_dedup.drop_common_lines(nothing).count() == 0
    cleaned = stages.clean_lines(messy.drop("n_lines"))
    assert cleaned.columns == messy.drop("n_lines").columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cleaned.collect())


def test_fingerprints(workers):
    texts = [None, "", " \n", "one", "one two", "One TWO three", "é É ß  x\x1cy z", "a b c " * 5000]
    texts += [r["text"] for r in table(workers, DATA, "documents").limit(30).collect()]
    for text in texts:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute.simhash(text)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_links(workers, bits):
    """Around centres, at distances on both sides of the threshold, in all bits."""
    draw = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        centre = draw.getrandbits(64)
        prints.add(centre)
        for _ in range(8):
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, bits + 2))))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    frame = workers.createDataFrame([(p,) for p in signed], "simhash long")
    expected = set(brute.near(prints, bits))
    for crowd in (2000, 2):
        got = {tuple(r) for r in simhash.links(frame, bits, crowd=crowd).collect()}
        unsigned = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in got}
        assert {tuple(sorted(p)) for p in unsigned} == expected


def test_anchors():
    """Every word has one code word within 1, and the flips reach all within 2."""
    for r in (3, 4):
        n = (1 << r) - 1
        syndrome = lambda w: __import__("functools").reduce(lambda s, p: s ^ (p if w >> (p - 1) & 1 else 0), range(1, n + 1), 0)
        code = {w for w in range(1 << n) if syndrome(w) == 0}
        flips = simhash._flips(r)
        for word in list(range(0, 1 << n, 37)):
            reached = {word ^ f for f in flips[syndrome(word)]}
            assert reached == {c for c in code if (c ^ word).bit_count() <= 2}
            assert word ^ flips[syndrome(word)][0] in code


def test_query(workers):
    docs = [(r["doc_id"], r["text"]) for r in table(workers, DATA, "documents").collect()]
    expected = {row[0]: least for row, least in brute.classes(docs).items()}
    rows = queries.QUERIES["op10_simhash_anchors"](workers, DATA).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    texts = dict(docs)
    assert all(int(r["fingerprint"], 16) == brute.simhash(texts[r["doc_id"]]) for r in rows)
    assert all(len(r["fingerprint"]) == 16 for r in rows)


def test_messy(messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    expected = brute.classes(rows)
    found = simhash.near_duplicates(messy).collect()
    by_id = defaultdict(set)
    for (doc, _), least in expected.items():
        by_id[doc].add(least)
    assert len(found) == len(rows)
    assert all(r["component_id"] in by_id[r["doc_id"]] for r in found)
    kept = stages.drop_copies(messy)
    assert kept.columns == messy.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == len({expected_class(row, rows) for row in rows})
    assert simhash.near_duplicates(nothing).count() == 0
    assert stages.drop_copies(nothing).count() == 0


def expected_class(row, rows):
    prints = {r: brute.simhash(r[1]) for r in rows}
    return brute.components(set(prints.values()), brute.near(prints.values(), 3))[prints[row]]


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(workers, kind):
    draw = random.Random(9)
    if kind == "chain":
        order = list(range(200))
        draw.shuffle(order)
        linked = list(zip(order, order[1:]))
    elif kind == "star":
        linked = [(500, i) for i in range(200)] + [(i, 900) for i in range(190, 220)]
    elif kind == "random":
        linked = [(draw.randrange(-300, 300), draw.randrange(-300, 300)) for _ in range(250)]
        linked = [(a, b) for a, b in linked if a != b]
    else:
        linked = []
    frame = workers.createDataFrame(linked, "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert got == brute.components({n for pair in linked for n in pair}, linked)


def test_whole_rows_are_shuffled_once(workers, tmp_path):
    """Survivors are right where ids and rows repeat; the plan deals rows with their text once."""
    words = "one two three four five six seven eight nine ten eleven twelve"
    other = " ".join(reversed(words.split()))
    rows = [(5, words, "a"), (2, words, "b"), (2, words, "b"), (None, words, "c"), (9, other, "d")]
    rows += [(None, "alone among all the rest of them here", "e")] * 3 + [(7, None, "f"), (8, "", "g")]
    path = str(tmp_path / "docs")
    workers.createDataFrame(rows, "doc_id long, text string, place string").write.parquet(path)
    kept = simhash.drop_near_duplicates(workers.read.parquet(path))
    assert kept.columns == ["doc_id", "text", "place"]
    assert Counter(r["place"] for r in kept.collect()) == Counter("bdef")
    with_join = workers.conf.get("spark.sql.autoBroadcastJoinThreshold")
    workers.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.drop_near_duplicates(workers.read.parquet(path))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        workers.conf.set("spark.sql.autoBroadcastJoinThreshold", with_join)
    assert text.count("text#") and "LeftSemi" in text
    above = text[: text.index("LeftSemi")]
    assert "Exchange" not in above
