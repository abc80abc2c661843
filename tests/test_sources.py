from __future__ import annotations

import random
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import DATA, rows_of
from vitrine.operators.filters import in_any_category, on_day
from vitrine.operators.joins import latest_per_key
from vitrine.operators import ordering
from vitrine.operators.ordering import (
    RangeIndex,
    latest,
    ordered_by,
    page,
    page_after,
    stack,
    sweep_days,
)
from vitrine.registry.tables import Tables
from vitrine.schemas import LISTINGS
from vitrine.session import work_dir, written
from vitrine.sinks.writers import write_by_day, write_csv, write_table
from vitrine.sources.readers import (
    hash_predicates,
    jdbc_options,
    jdbc_parts,
    name_by_position,
    range_predicates,
    read_csv,
    read_csv_with_lists,
)


def test_jdbc_options_of_a_plain_read():
    options = jdbc_options({"url": "jdbc:x"}, query="select 1", one_task=True)
    assert options == {"url": "jdbc:x", "query": "select 1", "fetchsize": "10000"}
    assert jdbc_options({"url": "jdbc:x"}, table="t", one_task=True)["dbtable"] == "t"


def test_jdbc_options_of_a_split_read():
    options = jdbc_options(
        {"url": "jdbc:x", "user": "u"},
        query="select * from t",
        split_on="created",
        lower=date(2024, 1, 1),
        upper=date(2024, 2, 1),
        parts=31,
    )
    assert options["dbtable"] == "(select * from t) AS source"
    assert "query" not in options
    assert options["partitionColumn"] == "created"
    assert (options["lowerBound"], options["upperBound"]) == ("2024-01-01", "2024-02-01")
    assert options["numPartitions"] == "31"


@pytest.mark.parametrize(
    "wrong",
    [
        {},
        {"query": "q", "table": "t"},
        {"table": "t", "split_on": "id"},
        {"table": "t", "parts": 4},
        {"table": "t"},
        {"table": "t", "one_task": True, "parts": 4},
    ],
)
def test_jdbc_options_refuse_half_a_request(wrong):
    with pytest.raises(ValueError):
        jdbc_options({"url": "jdbc:x"}, **wrong)
    with pytest.raises(ValueError):
        jdbc_options({}, table="t")


def test_jdbc_parts_by_text_keys():
    parts = jdbc_parts({"url": "jdbc:x", "user": "u"}, hash_predicates("crc32(url)", 3), query="q")
    assert parts["url"] == "jdbc:x" and parts["table"] == "(q) AS source"
    assert parts["properties"] == {"user": "u", "fetchsize": "10000"}
    assert parts["predicates"] == [
        "MOD(crc32(url), 3) = 0 OR (crc32(url)) IS NULL",
        "MOD(crc32(url), 3) = 1",
        "MOD(crc32(url), 3) = 2",
    ]
    with pytest.raises(ValueError):
        jdbc_parts({"url": "jdbc:x"}, [], table="t")
    with pytest.raises(ValueError):
        range_predicates("url", ["b", "a"])


@pytest.mark.parametrize("predicates", [hash_predicates("length(k)", 3), range_predicates("k", ["b", "d'", "x"])])
def test_each_row_meets_one_condition(spark, predicates):
    rows = spark.createDataFrame([(k,) for k in ("", "a", "bb", "c", "d'", "dd", "zzz", None)], "k string")
    met = [rows.where(p).collect() for p in predicates]
    assert sorted((r["k"] for part in met for r in part), key=str) == sorted((r["k"] for r in rows.collect()), key=str)


def test_csv_keeps_quotes_commas_nulls_and_blanks(spark):
    frame = spark.createDataFrame(
        [('a "b", c', None, "é"), (" ", "x\\y", "[{'a'}]"), ('"', "''", " lead")],
        "p string, q string, r string",
    )
    path = work_dir(spark)
    write_csv(frame, path)
    assert rows_of(read_csv(spark, path, frame.schema)) == rows_of(frame)


def test_empty_text_in_csv_is_read_as_null(spark):
    path = work_dir(spark)
    write_csv(spark.createDataFrame([("", "a")], "p string, q string"), path)
    schema = spark.createDataFrame([], "p string, q string").schema
    assert rows_of(read_csv(spark, path, schema)) == [(None, "a")]


def test_csv_with_line_breaks_in_cells(spark):
    frame = spark.createDataFrame([("a\nb", 1), ("c", 2)], "p string, n int")
    path = work_dir(spark)
    write_csv(frame, path)
    assert rows_of(read_csv(spark, path, frame.schema, multiline=True)) == rows_of(frame)


def test_csv_with_list_cells(spark):
    path = work_dir(spark)
    write_csv(spark.createDataFrame([("u", "['A', 'B, C']"), ("v", "[]")], "url string, names string"), path)
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("names", T.StringType())])
    got = {r["url"]: r["names"] for r in read_csv_with_lists(spark, path, schema, ["names"]).collect()}
    assert got == {"u": ["A", "B, C"], "v": []}


def test_domain_tables_as_csv(spark):
    rows = spark.createDataFrame(
        [("u", "i", '[{"name":"A, B"}]', None, 7, datetime(2024, 1, 5, 6, 7, 8))], LISTINGS
    )
    path = work_dir(spark)
    write_csv(rows, path)
    assert rows_of(read_csv(spark, path, LISTINGS)) == rows_of(rows)


def test_one_folder_per_day(spark):
    clicks = sweep_days(Tables(spark, DATA).clicks, "created", date(2024, 1, 3), date(2024, 1, 6))
    path = work_dir(spark)
    write_by_day(clicks, path, "snapshot_date")
    back = spark.read.parquet(path)
    assert rows_of(back) == rows_of(clicks)
    one = back.where("snapshot_date = date'2024-01-04'")
    assert len(one.inputFiles()) <= len(back.inputFiles())
    assert one.count() == clicks.where("snapshot_date = date'2024-01-04'").count()


def test_overwrite_replaces(spark):
    path = work_dir(spark)
    for n in (3, 2):
        write_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 2


def session_with(folder, master):
    context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
    return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)


def test_work_dir_is_below_the_folder_of_the_session(spark):
    assert work_dir(session_with("hdfs://shared/", "yarn")).startswith("hdfs://shared/vitrine-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session_with(None, "yarn"))
    assert work_dir(spark) != work_dir(spark)


def test_names_by_position(spark):
    frame = name_by_position(spark.createDataFrame([(1, "a")], "x int, y string"), ["n", "t"])
    assert frame.columns == ["n", "t"]


def test_day_slices_stacked_equal_the_sweep(spark):
    clicks = Tables(spark, DATA).clicks
    slices = [
        sweep_days(clicks, "created", date(2024, 1, d), date(2024, 1, d + 1)) for d in range(1, 12)
    ]
    assert rows_of(stack(slices)) == rows_of(
        sweep_days(clicks, "created", date(2024, 1, 1), date(2024, 1, 12))
    )
    assert rows_of(clicks.where(on_day(F.col("created"), date(2024, 1, 5)))) == rows_of(
        slices[4].drop("snapshot_date")
    )


def test_pages_cover_all_rows_once(spark):
    rows = spark.range(25).withColumn("k", F.col("id") % 3)
    pages = [page(rows, ["k", "id"], offset, 10) for offset in (0, 10, 20)]
    assert [p.count() for p in pages] == [10, 10, 5]
    assert rows_of(stack(pages)) == rows_of(rows)


def test_a_deep_page_is_cut_from_few_ranges(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 7)
    found = page(rows, ["k desc", "id"], 15_000, 10)
    want = rows.orderBy(F.desc("k"), "id").offset(15_000).limit(10)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "limit=15010" not in plan
    assert page(rows, ["id"], 50_000, 10).count() == 0


@pytest.mark.parametrize("order", [["k", "t", "id"], ["k desc", "t", "id desc"], ["t desc", "k desc", "id"]])
def test_pages_of_keys_with_nulls(spark, order):
    dice = random.Random(4)
    days = [None, *(datetime(2024, 1, d) for d in range(1, 6))]
    rows = [(dice.choice([None, "a", "b", "ñ"]), dice.choice(days), n, "wide" * 50) for n in range(400)]
    frame = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, rest string")
    by = ordered_by(*order)
    index = RangeIndex.of(frame, order, ranges=7)
    assert sum(index.counts) == 400 and len(index.counts) > 3
    want = [tuple(r) for r in frame.orderBy(*[b.sort for b in by]).collect()]
    for offset in (0, 63, 390, 400):
        got = [tuple(r) for r in index.page(frame, offset, 40).collect()]
        assert got == want[offset : offset + 40]
    at = [("k", "t", "id").index(b.name) for b in by]
    for place in (0, 150, 399):
        key = [want[place][i] for i in at]
        got = [tuple(r) for r in page_after(frame, order, key, 25).collect()]
        assert got == want[place + 1 : place + 26]


def test_an_index_holds_keys_only(spark, monkeypatch):
    """What is written for a page does not grow with the width of the rows."""
    kept = []
    monkeypatch.setattr(ordering, "written", lambda rows: kept.append(rows.columns) or written(rows))
    rows = spark.range(1000).withColumn("wide", F.repeat(F.lit("x"), 500))
    found = page(rows, ["id"], 500, 10)
    assert kept == [["id", "_range"]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" in plan and " >= " in plan
    with pytest.raises(ValueError):
        page(rows, ["id upwards"], 0, 1)


def test_latest_rows(spark):
    rows = spark.createDataFrame(
        [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 3)), (3, datetime(2024, 1, 3)), (4, None)],
        "id int, created timestamp_ntz",
    )
    assert [r["id"] for r in latest(rows, 2, "created", "id").collect()] == [3, 2]


def test_newest_row_per_key(spark):
    rows = spark.createDataFrame(
        [(1, "a", datetime(2024, 1, 1)), (1, "b", datetime(2024, 2, 1)), (2, "c", datetime(2023, 1, 1)),
         (None, "d", datetime(2025, 1, 1))],
        "k int, v string, created timestamp_ntz",
    )
    got = {r["k"]: r["v"] for r in latest_per_key(rows, "k", "created").collect()}
    assert got == {1: "b", 2: "c"}


@pytest.mark.parametrize(
    ("path", "targets", "match_case", "found"),
    [
        ("a,b", ("B",), False, True),
        ("a,b", ("B",), True, False),
        (None, ("a",), False, False),
        ("", ("a",), False, False),
        ("", ("",), False, False),
        ("x", ("",), False, True),
        ("a", (), False, False),
        ("a.b", ("a+b", "a.b"), False, True),
        ("axb", ("a.b",), False, False),
        ("cámaras y más", ("CÁMARAS Y",), False, True),
        ("a\nb", ("b",), False, True),
    ],
)
def test_in_any_category(spark, path, targets, match_case, found):
    frame = spark.createDataFrame([(path,)], "path string")
    assert frame.select(in_any_category(F.col("path"), targets, match_case)).first()[0] is found
