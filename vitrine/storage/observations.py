"""Observations stored by listing: join, window and totals by listing need no shuffle of them.

The rows lie in folders by month and in these in buckets by listing (Spark's bucketed tables), sorted
by listing and time; a look-back reads its months only, and the same bucket of all months is one task's.
The history of a hot listing is cut into slices when it is written, and its rows lie in buckets by listing and
slice, so no bucket holds a listing too large for a task. New rows can be appended. Beside the rows the folder keeps the borders
of the slices and the summary of the keys, so a plan over the table is built without reading it.

``Stored.scope`` hands the layout to the reports.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.skew import DEFAULT_POLICY, SLICE, SkewPolicy, Slices, plan_slices
from vitrine.plans.config import Scope
from vitrine.storage.hot_keys import hot_from_summary, summarize

_MONTH = "_month"


@dataclass(frozen=True)
class Layout:
    """How a folder of observations is laid out."""

    key: str
    time: str
    tiebreak: tuple[str, ...]
    buckets: int
    sliced: bool
    schema: str

    @property
    def by(self) -> tuple[str, ...]:
        return (self.key, SLICE) if self.sliced else (self.key,)


@dataclass(frozen=True)
class Stored:
    """An opened folder."""

    spark: SparkSession
    path: str
    layout: Layout
    name: str

    @property
    def rows(self) -> DataFrame:
        """All rows with a key, with the number of their slice if there are hot listings."""
        return self.spark.table(self.name).drop(_MONTH)

    def since(self, day: date) -> DataFrame:
        """The rows of the day and later; months before it are not read."""
        rows = self.spark.table(self.name).where(F.col(_MONTH) >= F.lit(day.replace(day=1)))
        return rows.where(F.col(self.layout.time) >= F.lit(day)).drop(_MONTH)

    @property
    def unkeyed(self) -> DataFrame:
        """Rows without a key. They belong to no listing and lie apart."""
        return self.spark.read.schema(self.layout.schema).parquet(f"{self.path}/unkeyed")

    @property
    def summary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/summary")

    @property
    def slices(self) -> Slices:
        """The slices the rows carry. Found when the table was written; no job runs."""
        plain = Slices((self.layout.key,), self.layout.time, self.layout.tiebreak)
        if not self.layout.sliced:
            return plain
        return replace(plain, hot=self.spark.read.parquet(f"{self.path}/slices"))

    def scope(self, scope: Scope) -> Scope:
        """The scope of a report over these rows."""
        return replace(scope, slices=self.slices, tiebreak=self.layout.tiebreak)

    def append(self, rows: DataFrame) -> None:
        """Add rows, such as those of a new day, to their months and buckets.

        Rows of a hot listing after its last border go to its last slice: see outgrown.
        """
        known = rows.where(F.col(self.layout.key).isNotNull())
        summarize(known, self.layout.key, self.layout.time).write.mode("append").parquet(
            f"{self.path}/summary"
        )
        rows.where(F.col(self.layout.key).isNull()).write.mode("append").parquet(f"{self.path}/unkeyed")
        labelled = self.slices.label(known) if self.layout.sliced else known
        _write(labelled, self.path, self.layout, self.name, "append")

    def outgrown(self, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
        """(key, _rows): listings that are hot by now and were not when the slices were laid out.

        If there are any, or the last slice has grown, store the rows anew.
        """
        hot = hot_from_summary(self.summary, self.layout.key, policy)
        if not self.layout.sliced:
            return hot
        return hot.join(self.slices.hot.select(self.layout.key), self.layout.key, "left_anti")

    def close(self) -> None:
        """Forget the table's name. The folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def store_observations(
    rows: DataFrame,
    path: str,
    buckets: int,
    key: str = "url_id",
    time: str = "created",
    tiebreak: Sequence[str] = (),
    policy: SkewPolicy = DEFAULT_POLICY,
) -> Stored:
    """Write observations below a new folder and open it.

    buckets: at least the session's shuffle partitions, else Spark may prefer to shuffle; some 200 MB
        of rows to a bucket.

    Each bucket is written by one task into one file. What is hot is read from the summary, which is
    made first; borders of slices are looked for only where a key is hot.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(key).isNotNull())
    summarize(known, key, time).write.parquet(f"{path}/summary")
    slices = Slices((key,), time, tuple(tiebreak))
    if policy.enabled:
        hot = hot_from_summary(spark.read.parquet(f"{path}/summary"), key, policy)
        if not hot.isEmpty():
            slices = plan_slices(known, [key], time, policy, tiebreak, hot)
            slices.hot.write.parquet(f"{path}/slices")
            slices = replace(slices, hot=spark.read.parquet(f"{path}/slices"))
            known = slices.label(known)
    layout = Layout(key, time, tuple(tiebreak), buckets, slices.any, json.dumps(rows.schema.jsonValue()))
    rows.where(F.col(key).isNull()).write.parquet(f"{path}/unkeyed")
    name = _name()
    _write(known, path, layout, name, "errorifexists")
    about = spark.createDataFrame([(json.dumps(asdict(layout)),)], "value string")
    about.coalesce(1).write.text(f"{path}/about")
    return _opened(spark, path, layout, name)


def _write(rows: DataFrame, path: str, layout: Layout, name: str, mode: str) -> None:
    # A row without a time lies in the folder of no month, which every look-back leaves out.
    months = rows.withColumn(_MONTH, F.trunc(layout.time, "month"))
    (
        months.repartition(layout.buckets, *layout.by)
        .write.format("parquet")
        .mode(mode)
        .partitionBy(_MONTH)
        .bucketBy(layout.buckets, *layout.by)
        .sortBy(*layout.by, layout.time, *layout.tiebreak)
        .option("path", f"{path}/rows")
        .saveAsTable(name)
    )


def open_observations(spark: SparkSession, path: str) -> Stored:
    """Open a folder written before, also in another session."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    layout = Layout(**{**about, "tiebreak": tuple(about["tiebreak"])})
    name = _name()
    schema = T.StructType.fromJson(json.loads(layout.schema))
    if layout.sliced:
        schema = schema.add(SLICE, T.IntegerType())
    schema = schema.add(_MONTH, T.DateType())
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{column}`" for column in layout.by)
    order = ", ".join(f"`{column}`" for column in (*layout.by, layout.time, *layout.tiebreak))
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({_MONTH}) CLUSTERED BY ({by}) SORTED BY ({order}) "
        f"INTO {layout.buckets} BUCKETS LOCATION '{path}/rows'"
    )
    spark.catalog.recoverPartitions(name)
    return _opened(spark, path, layout, name)


def _name() -> str:
    return f"vitrine_{uuid.uuid4().hex}"


def _opened(spark: SparkSession, path: str, layout: Layout, name: str) -> Stored:
    plain = T.StructType.fromJson(json.loads(layout.schema))
    return Stored(spark, path, replace(layout, schema=_ddl(plain)), name)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
