"""Exact top-k search by branch and bound over columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.blocks import asked, best_of, matrix, meet, nearest, table_of, vectors

#: Dimensions added up between two looks at the bounds.
STEP = 8
LONGS = (-(1 << 63), (1 << 63) - 1)


def quantized(rows: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x): as doubles if sums of their products are exact there, else as integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(rows * float(scale))
    most = np.abs(whole).max(initial=0.0)
    if most * most * max(1, rows.shape[1]) < 2.0**52:
        return whole
    exact = [[int(x // 1) for x in map(lambda v: _scaled(v, scale), row)] for row in rows.tolist()]
    return np.array(exact, dtype=object).reshape(rows.shape)


def _scaled(value: float, scale: int) -> int:
    top, bottom = value.as_integer_ratio()
    return top * scale // bottom


def top(columns: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int):
    """The k rows of greatest inner product with the query; `columns` has a row for a dimension.

    Dimensions go in order of the query's weight, STEP at a time. What the rest can still add to
    a row is at most the product of the lengths of both rests, so each row has a lower and an
    upper bound; rows whose upper bound is below the k-th lower bound are left out, and the rest
    is moved together. In the end the sums are whole, and exact.
    """
    alive = np.flatnonzero(ids != own)
    sums = np.zeros(len(alive))
    order = np.argsort(-np.abs(query), kind="stable")
    rest = np.einsum("ij,ij->j", columns, columns)[alive]
    weight = float(query @ query)
    for first in range(0, len(order), STEP):
        dims = order[first : first + STEP]
        block = columns[dims][:, alive]
        part = query[dims]
        sums = sums + part @ block
        rest = np.maximum(rest - np.einsum("ij,ij->j", block, block), 0.0)
        weight = max(weight - float(part @ part), 0.0)
        if len(alive) > 4 * k and first + STEP < len(order):
            slack = np.sqrt(rest * weight) * (1 + 1e-9) + 1.0
            bar = np.partition(sums - slack, len(sums) - k)[len(sums) - k]
            keep = sums + slack >= bar
            if keep.sum() < 0.8 * len(alive):
                alive, sums, rest = alive[keep], sums[keep], rest[keep]
    return best_of(ids[alive], sums, k)


def search_block(held: pa.Table, wanted: pa.Table, k: int, scale: int) -> pa.Table:
    out = []
    if held.num_rows and wanted.num_rows:
        ids = held.column("id").to_numpy()
        rows, points = matrix(held, "vector"), matrix(wanted, "vector")
        own, asks = quantized(rows, scale), quantized(points, scale)
        if own.dtype == object or asks.dtype == object or _large(own, asks):
            own, asks = own.astype(object), asks.astype(object)
            whole = np.vectorize(int, otypes=[object])
            own, asks = whole(own) if own.size else own, whole(asks) if asks.size else asks
        columns = np.ascontiguousarray(own.T)
        for query, point in zip(wanted.column("id").to_pylist(), asks):
            if columns.dtype == object:
                some = np.flatnonzero(ids != query)
                sums = [sum(map(int.__mul__, row, point.tolist())) for row in own[some].tolist()]
                best = sorted(zip(sums, ids[some].tolist()), key=lambda x: (-x[0], x[1]))[:k]
                found = np.array([i for _, i in best], dtype=np.int64)
                held_in = [min(max(s, LONGS[0]), LONGS[1]) for s, _ in best]
                out.append((query, found, np.array(held_in, dtype=np.int64)))
            else:
                found, sums = top(columns, ids, point, query, k)
                out.append((query, found, sums.astype(np.int64)))
    out = [(q, i, s.astype(np.int64)) for q, i, s in out]
    held_out = table_of(out, None)
    return held_out.set_column(2, "score", held_out.column("score").cast(pa.int64()))


def _large(own: np.ndarray, asks: np.ndarray) -> bool:
    most = np.abs(own).max(initial=0.0) * np.abs(asks).max(initial=0.0)
    return most * max(1, own.shape[1]) >= 2.0**52


def exact_top(
    rows: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    identity: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products, exactly.

    Components become floor(scale * x). All rows are searched for each row whose id `every`
    divides, in blocks of 1,024 to 16,384 rows held by dimension (see top).

    Vectors that are null or hold null or non-finite components take no part. A row without an id is
    a candidate, after all others in ties, with a null vec_id, and no query. Vectors meet those of equal dimension only; empty ones meet with score 0. A repeated id is
    one query; rows of its id are not its candidates. Numbers too large for doubles are added as
    integers of any size, without bounds; a score beyond 64 bits is given as the nearest long. An
    empty table gives an empty result.
    """
    held = vectors(rows, identity, vector)
    found = meet(
        held,
        asked(held, every),
        lambda block, wanted: search_block(block, wanted, k, scale),
        "query_id long, vec_id long, score long",
    )
    return nearest(found, k)
