"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_near_copies import plain_lines
from vitrine.llm import queries, stages, toxicity
from vitrine.llm.shared import materialize, table

BAR = (stages.BOILERPLATE_RATIO, stages.BOILERPLATE_PAGES, stages.BOILERPLATE_SURE)


@pytest.fixture(scope="module")
def steps(workers):
    """Input and output of each stage."""
    docs, out = table(workers, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(workers, docs, DATA))
        out.append((name, docs, done))
        docs = done
    return out


def test_stages(steps):
    assert [name for name, _, _ in steps] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing",
    ]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_toxicity(workers, steps):
    _, before, after = steps[0]
    model = toxicity.fit(before, table(workers, DATA, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_scores(before, model).collect()}
    assert {r["doc_id"] for r in after.collect()} == {d for d, s in scores.items() if s < 0.5}


def test_line_dedup(steps):
    _, before, after = steps[1]
    rows = [(r["source"], r["text"]) for r in before.collect()]
    expected = Counter((s, t) for s, t, _, _ in plain_lines(rows, *BAR))
    assert Counter((r["source"], r["text"]) for r in after.collect()) == expected


def test_near_dedup(steps):
    _, before, after = steps[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in after.collect()} == set(brute.classes(rows).values())


def test_mixing(steps):
    _, before, after = steps[3]
    other = duckdb.connect()
    documents = before.toPandas()  # noqa: F841  (read by name)
    expected = other.sql(queries.MIX_SQL).fetchall()
    times = {doc: taken // size for doc, size, _, _, taken in expected if size}
    got = Counter(r["doc_id"] for r in after.collect())
    assert {d: got[d] for d in times} == times


def test_packing(steps):
    _, before, after = steps[4]
    sizes = Counter(r["doc_id"] for r in before.collect())
    pieces = defaultdict(int)
    for r in after.collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {d: n // t for (d, t), n in pieces.items()} == dict(sizes)


def test_run(workers, steps):
    rows = corpus_pipeline.run(workers, DATA)
    assert sorted(rows.columns) == sorted(steps[-1][2].columns)
    total = lambda frame: Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in frame.collect())
    assert total(rows) == total(steps[-1][2])


def test_messy(workers, messy, tmp_path):
    labels = workers.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").limit(0)
    for folder, docs in ((f"{tmp_path}/some", messy), (f"{tmp_path}/none", messy.limit(0))):
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(workers, folder)
        assert (out.count() > 0) == (docs.count() > 0)
    assert stages.take_mix(messy).columns == messy.columns
