"""Both searches against all products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA
from vitrine.llm import blocks, neighbours, queries, topk
from vitrine.llm.shared import materialize, table


def held(workers, folder=DATA):
    rows = table(workers, folder, "embeddings").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)


def by_query(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    return out


def test_recall(workers):
    ids, vectors = held(workers)
    found = by_query(queries.QUERIES["op3_hash_prefix_forest"](workers, DATA).collect())
    assert sorted(found) == [i for i in sorted(ids) if i % 20 == 0]
    recalls = []
    for query, rows in found.items():
        scores = vectors @ vectors[ids.index(query)]
        order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-scores[i], ids[i]))
        assert len(rows) == 20 and len({v for v, _ in rows}) == 20
        assert all(math.isclose(s, scores[ids.index(v)], abs_tol=1e-12) for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        recalls.append(len({v for v, _ in rows} & {ids[i] for i in order[:20]}) / 20)
    assert sum(recalls) / len(recalls) >= 0.9


def sphere(rows, dims, seed):
    points = np.random.default_rng(seed).standard_normal((rows, dims))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_forest_alone():
    """No bound for small tables, nothing near but by chance: recall, and the share of rows scored."""
    rows = sphere(16_384, 64, 3)
    rows[1::40] = rows[::40][: len(rows[1::40])] + 0.002  # near copies
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    strings = neighbours.hash_strings(neighbours._on_sphere(rows, 1.0))
    own = np.arange(0, 16_384, 160)
    asks = neighbours.hash_strings(np.hstack([rows[own], np.zeros((len(own), 1))]))
    recalls, shares = [], []
    for query, met in zip(own.tolist(), neighbours.candidates(strings, asks, 1639)):
        scores = rows @ rows[query]
        scores[query] = -np.inf
        best = np.argsort(-scores)[:20]
        recalls.append(np.isin(best, met).mean())
        shares.append(len(met) / len(rows))
    assert np.mean(recalls) >= 0.9
    assert np.mean(shares) < 0.2


def test_longest_prefixes_first():
    """Whatever letters a query ends at, it meets the rows of that prefix in every tree, and no others."""
    random = np.random.default_rng(5)
    strings = random.integers(0, 4, (300, neighbours.TREES, neighbours.LETTERS))
    word = lambda letters: (letters << neighbours.BITS * np.arange(neighbours.LETTERS)[::-1]).sum(-1)
    for enough in (1, 60, 150, 280, 10**6):
        found = neighbours.candidates(word(strings).astype(np.int32), word(strings[:20]).astype(np.int32), enough)
        for query, met in zip(strings[:20], found):
            for letters in range(neighbours.LETTERS, -1, -1):
                same = (strings[:, :, :letters] == query[:, :letters]).all(-1)
                if same.any(1).sum() >= enough or not letters:
                    break
            assert met.tolist() == np.flatnonzero(same.any(1)).tolist()


def test_copies_do_not_crowd_out(workers):
    """A third of the rows hold one vector: it counts once, with as many ids as can be wanted."""
    n = 16_500
    points = sphere(n, 64, 7)
    rows = [(i, (points[0] if i % 3 == 0 else points[i]).tolist()) for i in range(n)]
    frame = workers.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    kept = neighbours.few_copies(blocks.vectors(frame, "vec_id", "embedding"), 20)
    assert kept.filter("id % 3 = 0").count() == 21
    assert kept.count() == 21 + 2 * n // 3
    found = by_query(neighbours.neighbours(frame, every=100, enough=1).collect())
    vectors = np.array([v for _, v in rows])
    recalls = []
    for query, ranked in found.items():
        scores = np.round(vectors @ vectors[query], 12)
        best = sorted((i for i in range(n) if i != query), key=lambda i: (-scores[i], i))[:20]
        recalls.append(len({v for v, _ in ranked} & set(best)) / 20)
        if query % 3 == 0:
            assert [v for v, _ in ranked] == best
    assert len(found) == n // 100 and np.mean(recalls) >= 0.9


def test_exact_query(workers):
    ids, vectors = held(workers)
    whole = np.floor(256 * vectors).astype(np.int64)
    found = by_query(queries.QUERIES["op8_branch_and_bound"](workers, DATA).collect())
    assert sorted(found) == [i for i in sorted(ids) if i % 50 == 0]
    for query, rows in found.items():
        scores = whole @ whole[ids.index(query)]
        best = sorted((-int(s), i) for s, i in zip(scores, ids) if i != query)[:5]
        assert rows == [(i, -s) for s, i in best]


@pytest.mark.parametrize("dims", [1, 7, 8, 64])
def test_bounds(dims):
    random = np.random.default_rng(dims)
    rows = np.floor(256 * random.standard_normal((500, dims)) ** 3)
    rows[::7] = rows[0]
    ids = np.arange(500)
    for own in (0, 3, 499):
        found, sums = topk.top(np.ascontiguousarray(rows.T), ids, rows[own], own, 5)
        scores = rows @ rows[own]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != own)[:5]
        assert list(zip(found.tolist(), sums.tolist())) == [(i, -s) for s, i in best]


VECTORS = [
    (0, [1.0, 0.5]),
    (100, [1.0, 0.5]),
    (100, [1.0, 0.5]),
    (200, None),
    (300, [1.0, None]),
    (400, [float("nan"), 1.0]),
    (500, [float("inf"), 1.0]),
    (600, [0.0, 0.0]),
    (700, []),
    (800, [1.0, 2.0, 3.0]),
    (900, [1e300, 1.0]),
    (1000, [-2.0, 1.0]),
    (1001, [5.0, -1.0]),
    (None, [1.0, 1.0]),
]


@pytest.fixture(scope="module")
def odd(workers):
    return workers.createDataFrame(
        [(*row, 0, "x") for row in VECTORS], "vec_id long, embedding array<double>, dim int, id string"
    )


def test_odd_vectors(odd):
    found = by_query(neighbours.neighbours(odd, every=100).collect())
    taking_part = {0, 100, 900, 1000, 1001}
    assert set(found) == taking_part - {1001}
    assert {v for v, _ in found[0]} == taking_part - {0} | {None}
    assert [v for v, _ in found[0]].count(100) == 2
    assert neighbours.neighbours(odd.limit(0)).count() == 0


def test_odd_vectors_exact(odd):
    found = by_query(topk.exact_top(odd, every=100, k=9).collect())
    assert set(found) == {0, 100, 600, 900, 1000}
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    kept = [(i, v) for i, v in VECTORS if v and len(v) == 2 and None not in v and all(map(math.isfinite, v))]
    exact = lambda v: [int(256 * x) if abs(x) > 1e100 else math.floor(256 * x) for x in v]
    for query in (0, 1000):
        own = exact(dict(kept)[query])
        best = sorted(
            ((-sum(a * b for a, b in zip(own, exact(v))), i) for i, v in kept if i != query),
            key=lambda found: (found[0], found[1] is None, found[1]),
        )
        assert found[query] == [(i, clamp(-s)) for s, i in best]


def test_a_repeated_id_asks_with_its_least_vector(workers):
    rows = [(20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0])]
    for order in (rows, rows[::-1]):
        frame = workers.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        assert [v for v, _ in by_query(topk.exact_top(frame, every=20).collect())[20]] == [2, 1]


def test_equal_rows_spread_over_blocks(workers):
    """A third of the rows alike: no block holds more than twice its share of them."""
    rows = workers.range(9000).selectExpr(
        "if(id % 3 = 0, 0L, id) as id",
        "if(id % 3 = 0, array(1D, 2D), array(cast(id as double), 1D)) as vector",
        "2 as dim",
    )
    rows = materialize(rows.repartition(5))

    def count(block, asked):
        return pa.table({"id": [0], "n": [block["id"].to_pylist().count(0)]})

    queries_ = rows.limit(1)
    held = [r["n"] for r in blocks.meet(rows, queries_, count, "id long, n long").collect()]
    assert sum(held) == 3000 and max(held) <= 2 * 3000 / len(held)


def test_exact_on_nothing(odd):
    assert topk.exact_top(odd.limit(0)).count() == 0
