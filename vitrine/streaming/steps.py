"""Stock changes of observations as they arrive.

The batch form (operators.panel.with_previous) sorts the whole history of a listing. Here a listing
keeps its last stepped observation, and the rows that wait for the watermark. When the watermark has
passed a row, no earlier one can come any more: it is stepped, in the order of time and tie-break.

Listings are stepped in groups, as Arrow blocks (streaming.groups), or each by itself.

Rule for late rows: a row that arrives after the watermark has passed its time is left out, and no
step that was given out changes. The watermark is ``delay`` behind the newest row of all listings.
State and watermark are in the checkpoint, so a run that breaks off goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from vitrine.streaming.groups import PACKED, STEPPED, GroupSteps, packed, unpacked

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Kinds that Arrow tells apart and orders as Spark does.
_FLAT = (T.IntegralType, T.BooleanType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


class _Steps(StatefulProcessor):
    """One listing: rows wait by time. Its only timer is that of the first row that waits; when it
    fires, all rows that the watermark has passed are stepped."""

    def __init__(self, order: Sequence[str], waiting: T.StructType, out: T.StructType):
        self.ordered, self.schema, self.out = 1 + len(order), waiting, Row(*out.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # The key and the watermark's column are not kept.
        arrived = [tuple(row[2:]) for row in rows]
        self.waiting.appendList(arrived)
        first = min(row[0] for row in arrived) // 1000
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # A row of the watermark's own millisecond may still come.
        passed = timerValues.getCurrentWatermarkInMs() - 1
        until = max(passed, expiredTimerInfo.getExpiryTimeInMs())
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] // 1000 <= until else rest).append(tuple(row))
        if rest:
            self.handle.registerTimer(min(row[0] for row in rest) // 1000)
        if not due:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        n = self.ordered
        due.sort(key=lambda row: tuple((value is not None, value) for value in row[:n]))
        before = self.last.get()
        for row in due:
            earlier = before[n:] if before else (None,) * len(row[n:])
            yield self.out(*key, *row, *earlier)
            before = row
        self.last.update(before)

    def close(self) -> None:
        pass


def previous_in_stream(
    rows: DataFrame,
    key: str,
    time: str,
    tiebreak: Sequence[str],
    previous: dict[str, str],
    delay: str = "1 day",
    groups: int | None = 1024,
) -> DataFrame:
    """Streamed form of with_previous: for each ``{new: column}`` the value one observation earlier.

    Gives key, time, tie-break, the columns of ``previous`` and the new ones. Rows without a key or
    a time have no history and are left out.

    groups: listings are stepped together in so many groups. It must not change while a checkpoint
        is in use. None steps each listing by itself: its state alone is read when a row is due,
        which costs less where few listings of very many have rows in a batch. Keys and tie-breaks
        that Arrow can't order take that way too.
    """
    values = list(dict.fromkeys(previous.values()))
    kinds = {f.name: f.dataType for f in rows.schema}
    marked = (
        rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
        .withColumn("_event", F.col(time).cast("timestamp"))
        .withColumn("_at", F.unix_micros("_event"))
    )
    waiting = T.StructType([T.StructField("_at", T.LongType())])
    for name in (*tiebreak, *values):
        waiting = waiting.add(name, kinds[name])
    out = T.StructType([T.StructField(key, kinds[key]), *waiting.fields])
    for name in values:
        out = out.add(f"_before_{name}", kinds[name])
    flat = _flat(kinds[key]) and all(_flat(kinds[name], True) for name in tiebreak)
    if groups is not None and flat:
        group = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group")
        blocks = (
            marked.select(group, key, "_at", *tiebreak, *values)
            .mapInArrow(packed(groups), PACKED)
            .withWatermark("_newest", delay)
            .groupBy("_group")
            .transformWithState(
                GroupSteps(len(tiebreak), len(values)), STEPPED, "append", "eventTime"
            )
        )
        stepped = blocks.mapInArrow(unpacked(out.names), out)
    else:
        stepped = (
            marked.withWatermark("_event", delay)
            .select(key, "_event", "_at", *tiebreak, *values)
            .groupBy(key)
            .transformWithState(_Steps(tiebreak, waiting, out), out, "append", "eventTime")
        )
    when = F.timestamp_micros("_at").cast(kinds[time]).alias(time)
    new = [F.col(f"_before_{column}").alias(name) for name, column in previous.items()]
    return stepped.select(key, when, *tiebreak, *values, *new)


def _flat(kind: T.DataType, order_only: bool = False) -> bool:
    """Floating numbers can be ordered, but as keys NaN and -0.0 would be told apart."""
    if isinstance(kind, T.FractionalType) and order_only:
        return True
    return isinstance(kind, _FLAT) or kind in (T.StringType(), T.BinaryType())


@contextmanager
def _state_of_many_keys(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def append_steps(stepped: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Take what has arrived, append the steps that are due, and stop.

    State is kept in RocksDB, on disk beyond memory, so it may have very many listings.
    """
    with _state_of_many_keys(stepped.sparkSession):
        return (
            stepped.writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
