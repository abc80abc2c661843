"""The Merkle manifest against trees built level by level."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from vitrine.llm import manifest, queries
from vitrine.llm.shared import table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def check(got, rows, fanout):
    """Rows (doc_id, source, lang, n_chars, text); equal ones may take each other's place."""
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    expected = brute.merkle(rows, lambda r: r[1], leaf, order, fanout)
    made = sorted(
        (leaf(rows[i]), s, root, str(way)) for i, (s, root, way) in expected.items()
    )
    assert made == sorted(
        (r["leaf"], r["subroot"], r["root"], str([tuple(step) for step in r["way"]])) for r in got
    )


@pytest.mark.parametrize("fanout, depth", [(3, 1), (3, 2), (2, 3), (3, 6), (5, 1)])
def test_trees(workers, fanout, depth):
    """Sources of 0 to some hundred rows: lone leaves, whole runs and last runs of one, many tiers."""
    rows = []
    for source, n in ((None, 1), ("a", 2), ("b", 3), ("c", 4), ("d", 27), ("é", 28), ("hot", 250), ("z", 10)):
        rows += [(i if i else None, source, "en", i, f"{source} {i % 40}") for i in range(n)]
    rows += rows[-3:] + [(7, "z", None, None, None), (7, "z", "", 0, "")]
    frame = workers.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = manifest.manifest(frame, FIELDS, "source", "doc_id", fanout=fanout, depth=depth)
    got = made.withColumn("ok", manifest.fold(F.col("leaf"), F.col("way")) == F.col("root")).collect()
    assert all(r["ok"] and r["changed_leaf"] == r["leaf"] for r in got)
    check(got, rows, fanout)


def test_no_joins_in_a_block(workers):
    nodes = workers.range(100).selectExpr("id % 2 as tree", "id as place", "struct('x' as hash, id as item) as node")
    plan = manifest._nested(nodes, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_query(workers):
    docs = table(workers, DATA, "documents").select(*FIELDS).collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_merkle_manifest"](workers, DATA).collect()}
    expected = brute.merkle(docs, lambda r: r["source"], leaf, lambda r: r["doc_id"])
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for i, (subroot, root, way) in expected.items():
        row, doc = got[docs[i]["doc_id"]], list(docs[i])
        if zlib.crc32(str(doc[0]).encode()) % 2 == 0 and doc[4] is not None:
            doc[4] = doc[4].replace("\n", "")
        folded = leaf(doc)
        for before, after in way:
            folded = digest(before + folded + after)
        proof = digest("".join(before + after for before, after in way))
        assert tuple(row) == (
            docs[i]["doc_id"], leaf(docs[i]), subroot, root, proof, folded, folded == root,
        )


def test_sql(workers):
    rows = duckdb.sql(queries.MANIFEST_SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'"))
    got = queries.QUERIES["op12_merkle_manifest"](workers, DATA).select(*rows.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())


def test_messy(messy, nothing):
    names = [*FIELDS, "Slot", "part"]
    made = manifest.manifest(messy, names, "source", "doc_id")
    rows = [tuple(r[n] for n in names) for r in messy.collect()]
    assert sorted(leaf(r) for r in rows) == sorted(r["leaf"] for r in made.collect())
    assert made.select("root").distinct().count() == 1
    assert manifest.manifest(nothing, names, "source", "doc_id").count() == 0
