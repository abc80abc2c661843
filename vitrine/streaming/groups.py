"""Steps of many listings at once: rows travel and wait as Arrow blocks, and are stepped by column.

Listings are dealt to groups by a hash. A task packs its rows into a block for each group, a group
keeps the blocks that wait and the last row of each of its listings, and blocks of stepped rows are
unpacked behind it. So Python is called for blocks, not for rows or listings.

Each group is called once whenever the watermark moves, to know the watermark that the rows of the
next batch may be late for. A task's first blocks therefore name all groups, also those without rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STEPPED = T.StructType([T.StructField("_block", T.BinaryType())])
PACKED = T.StructType(
    [T.StructField("_group", T.IntegerType()), T.StructField("_newest", T.TimestampType()), *STEPPED]
)
_CLOCK = T.StructType(
    [T.StructField("passed", T.LongType()), T.StructField("first", T.LongType())]
)

# Bytes a task collects before it packs them, and rows in a block of a group.
_COLLECT = 32 << 20
_ROWS = 1 << 16
_BEFORE_ALL = -(1 << 63)
_COMPRESSED = pa.ipc.IpcWriteOptions(compression="zstd")


def to_block(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_COMPRESSED) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_block(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _blocks(table: pa.Table) -> list[tuple[bytes]]:
    return [(to_block(table.slice(n, _ROWS)),) for n in range(0, table.num_rows, _ROWS)]


def _one_zone(schema: pa.Schema) -> pa.Schema:
    """The session's zone is only a label, and may be another one when the blocks are read."""
    for n, field in enumerate(schema):
        if pa.types.is_timestamp(field.type) and field.type.tz:
            schema = schema.set(n, field.with_type(pa.timestamp(field.type.unit, "UTC")))
    return schema


def packed(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of (group, key, time in microseconds, ...): gives PACKED."""

    def blocks(batches: list[pa.RecordBatch], name_all: bool) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        table = table.cast(_one_zone(table.schema))
        order = np.argsort(table.column(0).to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        group, at = table.column(0).to_numpy(), table.column(2).to_numpy()
        rows = table.drop_columns(table.column_names[0])
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        found, newest = group[starts].tolist(), np.maximum.reduceat(at, starts).tolist()
        held = [
            to_block(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(group)])
        ]
        if name_all:
            others = sorted(set(range(groups)).difference(found))
            found += others
            newest += [int(at.max())] * len(others)
            held += [None] * len(others)
        columns = [
            pa.array(found, pa.int32()),
            pa.array(newest, pa.timestamp("us", "UTC")),
            pa.array(held, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, PACKED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, name_all = [], 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.nbytes
            if size >= _COLLECT:
                yield blocks(kept, name_all)
                kept, size, name_all = [], 0, False
        if kept:
            yield blocks(kept, name_all)

    return run


def unpacked(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over STEPPED: the rows in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from from_block(block.as_buffer()).rename_columns(names).to_batches()

    return run


class GroupSteps(StatefulProcessor):
    """One group of listings: rows of (key, time in microseconds, tie-break, values)."""

    def __init__(self, ties: int, values: int):
        self.ties, self.values, self.out = ties, values, Row(*STEPPED.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The watermark of the last call (milliseconds), and the time of the first row that waits.
        self.clock = handle.getValueState("clock", _CLOCK)
        self.last = handle.getValueState("last", STEPPED)
        self.waiting = handle.getListState("waiting", STEPPED)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        clock = self.clock.get()
        # Spark has left out blocks that are late as a whole; late is what the batch before passed.
        passed, first = clock or (0, None)
        arrived = [from_block(row[2]) for row in rows if row[2] is not None]
        if arrived:
            table = pa.concat_tables(arrived)
            table = table.filter(pc.greater(table.column(1), passed * 1000))
            if table.num_rows:
                self.waiting.appendList(_blocks(table.combine_chunks()))
                earliest = _first(table)
                first = earliest if first is None else min(first, earliest)
        if clock is None:
            passed = timerValues.getCurrentWatermarkInMs()
            due = first is not None and first <= passed * 1000
            self.handle.registerTimer(passed if due else passed + 1)
        if clock is None or first != clock[1]:
            self.clock.update((passed, first))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        _, first = self.clock.get()
        # Spark leaves out what comes up to the watermark, so these rows are all there.
        if first is not None and first <= now * 1000:
            table = pa.concat_tables([from_block(row[0]) for row in self.waiting.get()])
            due = pc.less_equal(table.column(1), now * 1000)
            rest = table.filter(pc.invert(due)).combine_chunks()
            if rest.num_rows:
                self.waiting.put(_blocks(rest))
            else:
                self.waiting.clear()
            first = _first(rest)
            last = self.last.get()
            stepped, newest = self._steps(table.filter(due), last and from_block(last[0]))
            self.last.update((to_block(newest),))
            for block in _blocks(stepped):
                yield self.out(*block)
        self.clock.update((now, first))
        # A timer fires when the watermark reaches it: this one as soon as it moves.
        self.handle.registerTimer(now + 1)

    def _steps(self, due: pa.Table, last: pa.Table | None) -> tuple[pa.Table, pa.Table]:
        """The due rows with the values of the row before, and the last row of each listing."""
        known = last.num_rows if last else 0
        if known:
            # The last rows go before all others of their listings.
            at = pa.array(np.full(known, _BEFORE_ALL))
            ties = [pa.nulls(known, field.type) for field in list(due.schema)[2 : 2 + self.ties]]
            columns = [last.column(0), at, *ties, *last.columns[1:]]
            due = pa.concat_tables([pa.table(columns, schema=due.schema), due])
        # By place, as names may be any.
        rows = due.rename_columns([str(n) for n in range(due.num_columns)]).combine_chunks()
        keys = [(str(n), "ascending") for n in range(2 + self.ties)]
        order = pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")
        rows = rows.take(order).combine_chunks()
        listing = rows.column(0)
        starts = np.r_[True, pc.not_equal(listing[1:], listing[:-1]).to_numpy()]
        before = pa.array(np.arange(-1, len(starts) - 1), mask=starts)
        values = rows.columns[2 + self.ties :]
        stepped = pa.table(
            [*rows.columns, *(column.take(before) for column in values)],
            [str(n) for n in range(rows.num_columns + self.values)],
        ).filter(pa.array(order.to_numpy() >= known))
        ends = pa.array(np.r_[starts[1:], True])
        newest = pa.table([listing, *values], [str(n) for n in range(1 + self.values)])
        return stepped.combine_chunks(), newest.filter(ends).combine_chunks()

    def close(self) -> None:
        pass


def _first(table: pa.Table) -> int | None:
    return pc.min(table.column(1)).as_py() if table.num_rows else None
