from __future__ import annotations

import random
import shutil
from datetime import datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from tests.conftest import DATA, OFF, rows_of
from vitrine.operators.panel import with_previous
from vitrine.registry import QUERIES
from vitrine.session import work_dir
from vitrine.streaming.groups import GroupSteps, from_block, packed, to_block
from vitrine.streaming.steps import _Steps, append_steps, previous_in_stream
from vitrine.streaming.sweep import append_new_days

SCHEMA = "url_id string, created timestamp_ntz, price double"


def test_every_file_is_taken_once(spark):
    base = work_dir(spark)
    whole = []

    def arrive(day):
        rows = [(f"u{n}", datetime(2024, 1, day, n), float(n)) for n in range(4)]
        # Late rows of the day before are in the next file.
        rows.append(("late", datetime(2024, 1, day - 1, 23), 1.0))
        whole.extend(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def sweep():
        schema = spark.createDataFrame([], SCHEMA).schema
        query = append_new_days(spark, f"{base}/in", schema, f"{base}/out", f"{base}/check")
        query.awaitTermination()

    arrive(5)
    sweep()
    sweep()
    arrive(6)
    sweep()
    out = spark.read.parquet(f"{base}/out")
    assert rows_of(out.drop("snapshot_date")) == rows_of(spark.createDataFrame(whole, SCHEMA))
    days = {str(r["snapshot_date"]): r["count"] for r in out.groupBy("snapshot_date").count().collect()}
    assert days == {"2024-01-04": 1, "2024-01-05": 5, "2024-01-06": 4}


STEPS = "url_id string, created timestamp_ntz, id long, quantity double"


def test_steps_equal_the_batch_and_survive_restarts(spark):
    """Files arrive out of order within a day; each run takes new files and goes on from its state."""
    base = work_dir(spark)
    dice = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [
        (f"u{dice.randrange(5)}", start + timedelta(hours=n, minutes=dice.randrange(600)), n, float(dice.randrange(9)))
        for n in range(240)
    ]
    rows += [(None, start, 1000, 1.0), ("u1", None, 1001, 1.0)]
    schema = spark.createDataFrame([], STEPS).schema

    def run(*some):
        spark.createDataFrame(some, STEPS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        stepped = previous_in_stream(stream, "url_id", "created", ["id"], {"before": "quantity"}, "1 day")
        append_steps(stepped, f"{base}/out", f"{base}/check").awaitTermination()
        return spark.read.schema(stepped.schema).parquet(f"{base}/out")

    for part in (rows[:80], rows[80:160], rows[160:]):
        out = run(*part)
    assert 0 < out.count() < 240  # those of the last day still wait
    late = ("u1", start, 2000, 1.0)
    out = run(late, ("end", datetime(2100, 1, 1), 0, 0.0))
    frame = spark.createDataFrame([r for r in rows if r[0] and r[1]], STEPS)
    want = with_previous(frame, ["url_id"], "created", ["id"], {"before": "quantity"}, policy=OFF)
    assert rows_of(out) == rows_of(want.select(out.columns))


class _Listing:
    """State and timers of one listing, which count how often they are asked."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], set()
        self.reads = self.registered = 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.value, exists=lambda: self.value is not None, update=self._update)

    def getListState(self, name, schema):
        return SimpleNamespace(
            get=self._read,
            exists=lambda: bool(self.rows),
            appendList=lambda rows: self.rows.extend(rows),
            put=self._put,
            clear=lambda: self._put([]),
        )

    def _update(self, value):
        self.value = value

    def _put(self, rows):
        self.rows = list(rows)

    def _read(self):
        self.reads += 1
        return iter(list(self.rows))

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.registered += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_listing_has_one_timer_however_many_rows_wait(spark):
    """Rows of one firing are stepped together, so state calls don't grow with the rows."""
    waiting = T.StructType.fromDDL("_at long, id long, quantity double")
    out = T.StructType.fromDDL("url_id string, _at long, id long, quantity double, _before_quantity double")
    row = Row("url_id", "_event", "_at", "id", "quantity")
    listing, steps, given = _Listing(), _Steps(["id"], waiting, out), []
    steps.init(listing)

    def arrive(*times):
        rows = [row("u", None, at * 1000, at, float(at)) for at in times]
        steps.handleInputRows(("u",), iter(rows), None)

    def pass_to(watermark):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        for at in sorted(t for t in listing.timers if t < watermark):
            fired = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)
            given.extend(steps.handleExpiredTimer(("u",), now, fired))
            listing.deleteTimer(at)

    arrive(*range(1000, 0, -1))
    arrive(5000, 2000)
    pass_to(1)
    assert (given, listing.timers) == ([], {1})
    pass_to(2000)  # a row of the watermark's millisecond still waits
    assert [r[2] for r in given] == list(range(1, 1001)) and listing.timers == {2000}
    arrive(2000, 3000)
    pass_to(9000)
    assert [r[2] for r in given[1000:]] == [2000, 2000, 3000, 5000] and not listing.timers and not listing.rows
    before = [None, *(r[3] for r in given[:-1])]
    assert [r[4] for r in given] == before
    assert listing.reads == 2 and listing.registered == 2


class _State:
    """State and timers of one group, by name, with the calls counted."""

    def __init__(self):
        self.values, self.lists, self.timers, self.calls = {}, {}, set(), 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):
        return SimpleNamespace(
            get=lambda: self._call(self.values.get(name)),
            update=lambda value: self._call(self.values.update({name: value})),
        )

    def getListState(self, name, schema):
        rows = self.lists.setdefault(name, [])
        return SimpleNamespace(
            get=lambda: self._call(iter(list(rows))),
            appendList=lambda more: self._call(rows.extend(more)),
            put=lambda others: self._call(rows.__setitem__(slice(None), others)),
            clear=lambda: self._call(rows.clear()),
        )

    def registerTimer(self, at):
        self._call(self.timers.add(at))


def _group(steps, state):
    """Batches of one group: rows arrive, then the watermark's timers fire."""

    def batch(watermark, *rows):
        now, given = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), []
        if rows:
            names = [str(n) for n in range(len(rows[0]))]
            table = pa.table([pa.array(column) for column in zip(*rows)], names)
            block = Row("_group", "_newest", "_block")(0, None, to_block(table))
            given += steps.handleInputRows((0,), iter([block]), now)
        for at in sorted(t for t in state.timers if t <= watermark):
            fired = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)
            given += steps.handleExpiredTimer((0,), now, fired)
            state.timers.discard(at)
        return [tuple(r.values()) for out in given for r in from_block(out[0]).to_pylist()]

    return batch


@pytest.mark.parametrize("listings", [1, 500])
def test_state_calls_grow_neither_with_rows_nor_with_listings(listings):
    state, steps = _State(), GroupSteps(1, 1)
    steps.init(state)
    batch = _group(steps, state)
    rows = [(f"u{n % listings}", 1 + 5_000 - n, n, float(n)) for n in range(5_000)]
    assert batch(0, *rows, ("u0", 9_000_000, 1, 7.0)) == []
    out = batch(5_000)
    assert len(out) == 5_000 and state.timers == {5_001}
    want = sorted(rows)
    before = {}
    for row, got in zip(want, out, strict=True):
        assert got == (*row, before.get(row[0]))
        before[row[0]] = row[3]
    assert batch(9_000) == [("u0", 9_000_000, 1, 7.0, before["u0"])]
    assert state.calls < 20


def test_a_group_leaves_out_what_the_batch_before_had_passed():
    """The rows of a batch are late for the watermark of the batch before, also in a group that had none."""
    state, steps = _State(), GroupSteps(0, 1)
    steps.init(state)
    batch = _group(steps, state)
    assert batch(0, ("a", 100_000, 1.0), ("b", 900_000, 2.0)) == []
    assert batch(50) == []
    # Nothing is due, yet the group hears of the watermark.
    rows = [("c", 50_000, 3.0), ("c", 50_001, 4.0), ("a", 70_000, 5.0)]
    out = batch(70, *rows)
    assert out == [("a", 70_000, 5.0, None), ("c", 50_001, 4.0, None)]
    assert batch(80, ("b", 70_000, 6.0), ("a", 70_001, 7.0)) == [("a", 70_001, 7.0, 5.0)]
    # Rows after the watermark's time, in its own millisecond, wait.
    assert batch(900, ("b", 900_001, 8.0)) == [("a", 100_000, 1.0, 7.0), ("b", 900_000, 2.0, None)]
    assert batch(901) == [("b", 900_001, 8.0, 2.0)]


def test_a_task_names_every_group_once():
    def batches():
        for n in range(4):
            key = [f"u{i}" for i in range(3)]
            at = [n * 10 + i for i in range(3)]
            columns = [pa.array([2, 0, 2], pa.int32()), pa.array(key), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["_group", "url_id", "_at"])

    (out,) = packed(4)(batches())
    rows = {r["_group"]: r for r in out.to_pylist()}
    assert len(out) == 4 and sorted(rows) == [0, 1, 2, 3]
    assert rows[1]["_block"] is None and rows[3]["_block"] is None
    assert from_block(rows[2]["_block"]).column(1).to_pylist() == [0, 2, 10, 12, 20, 22, 30, 32]
    assert [rows[n]["_newest"].microsecond for n in range(4)] == [31, 32, 32, 32]


WIDE = (
    "url_id string, created timestamp_ntz, id long, part string, price decimal(12,2), "
    "quantity double, seen timestamp, tags array<string>"
)


@pytest.mark.parametrize("files", [None, 1])
def test_groups_step_as_listings_do(spark, files):
    """Null tie-breaks and values, late rows, listings that rest; some files to a run, or one to a batch."""
    dice = random.Random(11)
    start = datetime(2024, 1, 1)

    def row(n, hours):
        when = start + timedelta(hours=hours, minutes=dice.randrange(600), microseconds=dice.randrange(10**6))
        return (
            f"u{dice.randrange(30)}",
            when,
            n if dice.randrange(4) else None,
            dice.choice(["x", "é", "", None]),
            dice.choice([Decimal("1.50"), Decimal(n), None]),
            dice.choice([1.0, 2.5, float("inf"), None]),
            dice.choice([when, None]),
            dice.choice([["a"], [], None]),
        )

    parts = [[row(100 * k + n, 20 * k + n / 4) for n in range(60)] for k in range(5)]
    # Some that are late for all, and some that only the batch before the last lets in.
    for k in (2, 3, 4):
        parts[k] += [row(1000 * k + n, 20 * k - 4 * n) for n in range(15)]
    parts.append([("end", datetime(2100, 1, 1), 0, None, None, None, None, None)])
    schema = spark.createDataFrame([], WIDE).schema
    found = {}
    for groups in (None, 7):
        base = work_dir(spark)
        for k, part in enumerate(parts):
            frame = spark.createDataFrame(part, schema).coalesce(1)
            frame.write.mode("append").parquet(f"{base}/in")
            if files and k % 3 != 2:
                continue
            reader = spark.readStream.schema(schema)
            if files:
                reader = reader.option("maxFilesPerTrigger", files)
            stepped = previous_in_stream(
                reader.parquet(f"{base}/in"),
                "url_id",
                "created",
                ["id", "part", "price"],
                {"before": "quantity", "seen_before": "seen", "tags_before": "tags"},
                "12 hours",
                groups=groups,
            )
            append_steps(stepped, f"{base}/out", f"{base}/check").awaitTermination()
        found[groups] = rows_of(spark.read.schema(stepped.schema).parquet(f"{base}/out"))
    given = sum(map(len, parts)) - 1
    assert 200 < len(found[None]) < given
    assert found[7] == found[None]


def test_ties_that_arrow_cannot_order_are_stepped_by_listing(spark):
    schema = spark.createDataFrame([], WIDE).schema
    base = work_dir(spark)
    spark.createDataFrame([], schema).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    for tie, grouped in (("id", True), ("price", True), ("tags", False)):
        stepped = previous_in_stream(stream, "url_id", "created", [tie], {"before": "quantity"})
        assert ("MapInArrow" in stepped._jdf.queryExecution().logical().toString()) == grouped


def test_the_streamed_table_may_be_a_folder(spark, tmp_path):
    whole = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey < 500")
    whole.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    shutil.copy(f"{DATA}/part.parquet", tmp_path)
    got = rows_of(QUERIES["win_stock_change_streamed"](spark, str(tmp_path)))
    assert got and got == rows_of(QUERIES["win_stock_change"](spark, str(tmp_path)))
