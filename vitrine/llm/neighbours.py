"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.blocks import asked, best_of, matrix, meet, nearest, table_of, vectors
from vitrine.llm.shared import extended, materialize

TREES, LETTERS, AXES, SEED = 300, 4, 20, 71
BITS = (2 * AXES - 1).bit_length()  # a letter is one of the axes with a sign
#: Queries that meet one block of rows in a task, and those of them looked up at once.
QUERY_BLOCK, AT_ONCE = 32_768, 2048


@lru_cache(maxsize=2)
def _axes(dim: int, seed: int) -> np.ndarray:
    """For each tree and letter some axes at right angles to each other, of random direction."""
    random = np.random.default_rng(seed)
    width = min(AXES, dim)
    out = np.zeros((TREES * LETTERS, dim, AXES), dtype=np.float32)
    for turn in out:
        turn[:, :width] = np.linalg.qr(random.standard_normal((dim, width)))[0]
    return out


def hash_strings(vectors_: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(rows, trees): strings of letters, each as one number whose first letter is highest.

    A letter is the axis that a vector points along most, with the side: vectors at a small angle
    often share it.
    """
    out = np.zeros((len(vectors_), TREES), dtype=np.int32)
    single = vectors_.astype(np.float32)
    for number, turn in enumerate(_axes(vectors_.shape[1], seed)):
        along = single @ turn
        axis = np.abs(along).argmax(axis=1)
        side = along[np.arange(len(along)), axis] > 0
        tree = number // LETTERS
        out[:, tree] = out[:, tree] << BITS | (2 * axis + side)
    return out


def _on_sphere(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows scaled to length 1 at most, with a component that fills them up to 1.

    The angle to a query, whose own such component is 0, then orders rows by inner product.
    """
    scaled = rows / most if most and np.isfinite(most) else np.zeros_like(rows)
    left = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.hstack([scaled, left[:, None]])


def longest(rows: DataFrame) -> float:
    """The largest length of the vectors: all that the forest is fitted on."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return rows.agg(F.max(length).alias("most")).first()["most"] or 0.0


def index(rows: DataFrame, most: float | None, seed: int = SEED) -> DataFrame:
    """The rows (id, vector, dim) with `strings`, a hash string for each tree.

    `most` is the largest length of the rows searched; None hashes the rows as queries.
    """
    schema = extended(rows.schema, "strings array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.Table.from_batches([batch])
            for dim in set(held.column("dim").to_pylist()):
                part = held.filter(pc.equal(held.column("dim"), dim))
                for first in range(0, part.num_rows, 2048):
                    some = part.slice(first, 2048).combine_chunks()
                    own = matrix(some, "vector")
                    with np.errstate(all="ignore"):
                        if most is None:
                            points = np.hstack([_unit(own), np.zeros((len(own), 1))])
                        else:
                            points = _on_sphere(own, most)
                        strings = hash_strings(points, seed)
                    ends = np.arange(0, strings.size + 1, TREES, dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(strings.ravel()))
                    yield from some.append_column("strings", lists).to_batches()

    return rows.mapInArrow(run, schema)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by their largest component, which leaves their direction and fits any float."""
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """The rows (id, vector, dim) that can be among the k nearest of any query.

    Rows of one vector tie everywhere, so only those of its k + 1 least ids count, and k of each id.
    Copies are counted before the shuffle, and ids beyond the limit are left out before the sort,
    so no task holds a large group of copies.
    """
    counted = rows.groupBy("dim", "vector", "id").agg(F.count("*").alias("n"))
    least = Window.partitionBy("dim", "vector").orderBy("id")
    first = counted.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1)
    each = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))
    return first.select("id", "vector", "dim", each.alias("copy")).drop("copy")


def candidates(strings: np.ndarray, asks: np.ndarray, enough: int) -> Iterator[np.ndarray]:
    """For each query the numbers of the rows it meets.

    A tree is the sorted array of the rows' strings, in which rows of a common prefix stand next to
    each other. A query goes down each tree to its longest matching prefix, then up all trees at
    once, a letter at a time, until it has met `enough` different rows (its own, which every tree
    gives, is one of them). A query that has not met enough at one letter meets all rows.
    """
    rows = len(strings)
    order = np.ascontiguousarray(np.argsort(strings, axis=0, kind="stable").T)
    trees = np.take_along_axis(strings.T, order, axis=1)
    places = order.ravel()
    starts = np.arange(TREES) * rows
    met = np.zeros(rows, dtype=bool)
    for begin in range(0, len(asks), AT_ONCE):
        some = asks[begin : begin + AT_ONCE]
        first = np.empty((LETTERS, *some.shape), dtype=np.int64)
        sizes = np.empty_like(first)
        for up in range(LETTERS):
            prefix = some >> BITS * up
            for tree in range(TREES):
                low = np.searchsorted(trees[tree], prefix[:, tree] << BITS * up)
                first[up, :, tree] = low
                sizes[up, :, tree] = np.searchsorted(trees[tree], (prefix[:, tree] + 1) << BITS * up) - low
        total = sizes.sum(axis=2)
        for q in range(len(some)):
            for up in np.flatnonzero(total[:, q] >= enough).tolist():
                n = sizes[up, q]
                ahead = np.repeat(starts + first[up, q] - (np.cumsum(n) - n), n)
                met[:] = False
                met[places[ahead + np.arange(len(ahead))]] = True
                found = np.flatnonzero(met)
                if len(found) >= enough:
                    yield found
                    break
            else:
                yield np.arange(rows)


def search_block(held: pa.Table, wanted: pa.Table, k: int, enough: int) -> pa.Table:
    """The k best of a block for each query, of those met (see candidates), by the exact product."""
    kind = pa.float64()
    if not held.num_rows or not wanted.num_rows:
        return table_of([], kind)
    ids, own = held.column("id").to_numpy(), matrix(held, "vector")
    queries, points = wanted.column("id").to_numpy(), matrix(wanted, "vector")
    found = candidates(matrix(held, "strings", "int32"), matrix(wanted, "strings", "int32"), enough)
    out = []
    for query, point, some in zip(queries.tolist(), points, found):
        some = some[ids[some] != query]
        with np.errstate(all="ignore"):
            # Not a matrix product: it may round equal rows differently, by where they stand.
            products = np.einsum("ij,j->i", own[some], point)
            scores = np.nan_to_num(products, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        out.append((query, *best_of(ids[some], scores, k)))
    return table_of(out, kind)


def neighbours(
    rows: DataFrame,
    every: int = 20,
    k: int = 20,
    enough: int = 1000,
    share: float = 0.1,
    identity: str = "vec_id",
    vector: str = "embedding",
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for rows whose id `every` divides.

    Nearness is the largest inner product, in double precision on the vectors as they are. The
    forest is kept in blocks, each with its own sorted arrays, and every query asks every block
    (see search_block). A query goes up until the rows it met, in all trees together, are `share`
    of the block's rows, and about `enough` over all blocks; this sets recall against cost. Rows of
    one vector stand for each other (see few_copies), so copies do not fill a query's candidates.

    Vectors that are null, zero or hold null or non-finite components take no part. A row without an
    id is a candidate, after all others in ties, with a null vec_id, and no query. Vectors meet those
    of equal dimension only. A repeated id is one query, that of its least vector; its other rows are
    not its candidates, but they are candidates of others, each row for itself. With fewer
    candidates than k all that are found are returned; an empty table gives an empty result.
    """
    held = vectors(rows, identity, vector, F.exists(vector, lambda x: x != 0))
    forest = materialize(index(few_copies(held, k), longest(held), seed))
    part = max(share, enough / max(1, forest.count()))
    found = meet(
        forest,
        materialize(index(asked(held, every), None, seed)),
        lambda block, wanted: search_block(block, wanted, k, math.ceil(part * block.num_rows)),
        "query_id long, vec_id long, score double",
        QUERY_BLOCK,
    )
    return nearest(found, k)
