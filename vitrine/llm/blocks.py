"""A stated set of queries against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.shared import materialize

#: Stands for a null id: greater than all others, and never a query.
NO_ID = (1 << 63) - 1
#: Least and most rows of a block, blocks of a table that is neither small nor large, and queries
#: of a query block.
LEAST_ROWS, MOST_ROWS, BLOCKS, QUERIES = 1024, 16_384, 16, 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False))


def matrix(held: pa.Table, name: str, kind: str = "float64") -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    rows = held.num_rows
    flat = held.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(rows, -1 if rows and len(flat) else 0)


def meet(
    rows: DataFrame,
    queries: DataFrame,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    per_query_block: int = QUERIES,
) -> DataFrame:
    """compare(block of rows, block of queries) for all pairs of blocks of equal `dim`.

    Both sides have (id, vector, dim, ...) and are dealt into blocks by a hash of the row and the place
    it is read from, so equal rows spread; they should come from written tables. A block of rows has 1,024 rows in small tables and 16,384 in large ones, so that each query gets
    few partial answers. Rows are copied once for each block of queries, and queries once for each
    block of rows; a task holds one block of each.
    """
    n = rows.count()
    n_rows = max(1, -(-n // min(MOST_ROWS, max(LEAST_ROWS, n // BLOCKS))))
    n_queries = max(1, -(-queries.count() // per_query_block))

    def dealt(side: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        place = F.monotonically_increasing_id()
        of = F.pmod(F.xxhash64("id", "vector", place), F.lit(parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return side.withColumn(own, of).withColumn(other, every)

    keys = ["dim", "block", "query_block"]
    left = dealt(rows, "block", n_rows, "query_block", n_queries).groupBy(*keys)
    right = dealt(queries, "query_block", n_queries, "block", n_rows).groupBy(*keys)

    def both(held: pa.Table, asked: pa.Table) -> pa.Table:
        return compare(held, asked)

    return left.cogroup(right).applyInArrow(both, schema)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best (query_id, rank, vec_id, score): best score, then least vec_id."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id")
    return ranked.select("query_id", "rank", named, "score")


def vectors(rows: DataFrame, identity: str, vector: str, more: Column | None = None) -> DataFrame:
    """(id, vector, dim) of the rows that take part, written once. A null id is NO_ID."""
    taken = finite(F.col(vector))
    if more is not None:
        taken = taken & more
    return materialize(
        rows.filter(taken).select(
            F.coalesce(F.col(identity).cast("long"), F.lit(NO_ID)).alias("id"),
            F.col(vector).cast("array<double>").alias("vector"),
            F.size(vector).alias("dim"),
        )
    )


def asked(rows: DataFrame, every: int) -> DataFrame:
    """The queries: rows whose id is divisible by `every`. An id is one query, that of its least vector."""
    rest = [name for name in rows.columns if name != "id"]
    named = rows.filter((F.col("id") % every == 0) & (F.col("id") != NO_ID))
    least = named.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("dim", "vector")).alias("row"))
    return least.select("id", *[F.col(f"row.{name}") for name in rest])


def best_of(
    ids: np.ndarray, scores: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to smaller ids."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def table_of(out: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    sizes = [len(ids) for _, ids, _ in out]
    whole = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, dtype=t)
    return pa.table(
        {
            "query_id": pa.array(np.repeat([q for q, _, _ in out], sizes).astype(np.int64)),
            "vec_id": pa.array(whole([ids for _, ids, _ in out], np.int64).astype(np.int64)),
            "score": pa.array(whole([s for _, _, s in out], np.float64), type=kind),
        }
    )
