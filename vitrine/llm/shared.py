"""What several operators of this subpackage need: written intermediate tables and exact positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from vitrine.session import work_dir

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(rows: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the folder all executors share.

    Cuts the lineage: a lost executor costs only the tasks that read this table.
    """
    spark = rows.sparkSession
    path = work_dir(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand that many rows to Python at a time, as where a row is a large block."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def extended(schema: StructType, more: str) -> StructType:
    """The schema with more fields, given as DDL; the one given stays as it is."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Names that no column of the rows has, whatever the case of its letters."""
    taken = {name.lower() for name in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_positions(
    rows: DataFrame,
    order: list[Column],
    group: str | None = None,
    add: str | None = None,
    position: str = "position",
    before: str = "before",
) -> DataFrame:
    """The rows with their position from 0 in the given order, in each group or over all.

    With `add`, `before` holds the sum of that column over the rows that come earlier.
    The rows are dealt out by ranges of (group, order), so a hot group spreads over many tasks;
    each range is numbered alone, and one small table of totals (a row for each range and group)
    shifts the numbers. Rows equal in `order` follow the place they are read from, so a large group
    of equal rows spreads as well; they should come from a scan, which gives a task that runs again
    the same rows in the same order. Rows may be empty; nulls sort as `order` says, and a null group
    is a group.
    """
    part, key, counted, added, at, of, rows_before, sum_before, read = fresh(
        rows, "part", "key", "counted", "added", "at", "of", "rows_before", "sum_before", "read"
    )
    shown = rows.columns
    rows = rows.withColumn(read, F.monotonically_increasing_id())
    order = [*order, F.col(read).asc()]
    group = f"`{group}`" if group else None
    by_group = [F.col(group).asc_nulls_first()] if group else []
    dealt = materialize(
        rows.repartitionByRange(tasks(rows.sparkSession), *by_group, *order).withColumn(
            part, F.spark_partition_id()
        )
    )
    dealt = dealt.withColumn(key, F.struct(F.col(group) if group else F.lit(0).alias("all")))
    value = F.col(add) if add else F.lit(0)
    totals = dealt.groupBy(F.col(part).alias(at), F.col(key).alias(of)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("s")
    )
    earlier = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        at,
        of,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(rows_before),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias(sum_before),
    )
    inside = Window.partitionBy(part, key).orderBy(*order)
    numbered = dealt.withColumn(counted, F.row_number().over(inside) - 1)
    if add:
        so_far = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        numbered = numbered.withColumn(added, so_far - value)
    same = (F.col(part) == F.col(at)) & F.col(key).eqNullSafe(F.col(of))
    joined = numbered.join(shifts, same)
    made = (position.lower(), before.lower()) if add else (position.lower(),)
    shown = [F.col(f"`{name}`") for name in shown if name.lower() not in made]
    shown.append((F.col(counted) + F.col(rows_before)).cast("long").alias(position))
    if add:
        shown.append((F.col(added) + F.col(sum_before)).cast("long").alias(before))
    return joined.select(*shown)


def seeded(seed: int, *columns: Column) -> Column:
    """A hash that another SQL engine can compute as well."""
    text = [F.coalesce(column.cast("string"), F.lit("")) for column in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *text))


def add_columns(
    rows: DataFrame,
    source: str,
    kinds: str,
    make: Callable[[], Callable[[list], dict[str, pa.Array]]],
    keep: list[str] | None = None,
    batch: int = 256,
) -> DataFrame:
    """The rows with columns computed from one column by a Python function, in Arrow batches.

    `make` runs once in each task and gives a function from a list of values to the new columns,
    whose schema is `kinds`. At most `batch` rows are handed over at a time, whatever Spark's
    own batches are, so memory follows the texts of one small batch.
    """
    kept = keep if keep is not None else rows.columns
    added = StructType.fromDDL(kinds).names
    schema = extended(rows.select(*kept).schema, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                piece = whole.slice(start, batch)
                new = compute(piece.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(name) for name in kept] + [new[name] for name in added],
                    names=schema.names,
                )

    read = rows.select(*dict.fromkeys([*kept, source]))
    return read.mapInArrow(run, schema)
