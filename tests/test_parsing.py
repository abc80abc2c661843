from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrine.functions.dates import to_time
from vitrine.functions.names import (
    brand_names,
    breadcrumb_names,
    breadcrumb_path,
    last_name,
    literal_list,
    strip,
)
from vitrine.functions.numbers import (
    at_least_zero,
    at_most_zero,
    exact_sum,
    percent,
    to_number,
    to_number_strict,
)


def one(spark, build, text):
    frame = spark.createDataFrame([(text,)], "c string")
    return frame.select(build(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (None, None),
        ("", None),
        ("[]", []),
        ("{}", None),
        ("null", None),
        ("5", None),
        ('"x"', None),
        ("bad", None),
        ('{"name":"A"}', None),
        ('[{"name":"A"},null,{"name":"B"}]', ["A", "B"]),
        ('[{"nam":"A"},{"name":"B"}]', ["B"]),
        ('[{"name":null},{"name":"B"}]', ["B"]),
        ('[{"name":5}]', ["5"]),
        ("[{'name':'A'}]", None),
        ('["A","B"]', []),
        ('[{"name":"A"},0,"",[],{}]', ["A"]),
        ('[{"name":"A"}] rest', None),
        ('[{"name":"A"},{"name":', None),
        (' [ {"name":"A"} ]\n', ["A"]),
        ('[{"name":"Caf\\u00e9, t\\u00e9"},{"name":"B"}]', ["Café, té", "B"]),
    ],
)
def test_breadcrumb_names(spark, text, names):
    assert one(spark, breadcrumb_names, text) == names
    path = one(spark, lambda c: breadcrumb_path(c, lower=False), text)
    assert path == (None if names is None else ",".join(names))


def test_path_is_lowered_and_stripped_of_any_white_space(spark):
    text = '[{"name":"\\u00a0\\tELECTRÓNICA"},{"name":"Ñandú \\u2003\\n"}]'
    assert one(spark, breadcrumb_path, text) == "electrónica,ñandú"
    assert one(spark, strip, "\x0b　 a b \x85") == "a b"


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ('{"name":"A"}', ["A"]),
        ('[{"name":"A"},{"name":"B"}]', ["A", "B"]),
        ("[]", []),
        ("{}", []),
        ("bad", None),
        (None, None),
        ('[null,{"name":"A"}]', ["A"]),
    ],
)
def test_brand_names(spark, text, names):
    assert one(spark, brand_names, text) == names


def test_last_name(spark):
    assert one(spark, lambda c: last_name(breadcrumb_names(c)), '[{"name":"A"},{"name":"B"}]') == "B"
    assert one(spark, lambda c: last_name(breadcrumb_names(c)), "[]") is None


@pytest.mark.parametrize(
    ("text", "names"),
    [("['A', 'B']", ["A", "B"]), ("[]", []), (None, None), ('["L\'Or", \'x\']', ["L'Or", "x"]),
     ("['it\\'s']", ["it's"])],
)
def test_literal_list(spark, text, names):
    assert one(spark, literal_list, text) == names


@pytest.mark.parametrize(
    ("text", "number"),
    [
        (" 12 ", 12.0), ("1e3", 1000.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("\t3\n", 3.0),
        ("-0.25", -0.25), ("1e30", 1e30), ("1e-30", 1e-30), ("inf", math.inf),
        ("-Infinity", -math.inf), ("", None), (None, None), ("abc", None), ("1,000", None),
        ("1_000", None), ("0x10", None), ("0x1p3", None), ("1d", None), ("1f", None), ("1D ", None),
        ("NaN", None), ("1e400", None), ("1e", None), ("--1", None), ("1 2", None), ("٣", None),
        ("12345678901234567890123456789012345678901234567890", 1.2345678901234567e49),
    ],
)
def test_to_number(spark, text, number):
    assert one(spark, to_number, text) == number


def test_to_number_of_numbers(spark):
    frame = spark.createDataFrame([(float("nan"),), (1e10,), (None,)], "c double")
    assert [r[0] for r in frame.select(to_number(F.col("c"))).collect()] == [None, 1e10, None]


def test_strict_numbers_stop_the_job(spark):
    assert one(spark, to_number_strict, "7") == 7.0
    assert one(spark, to_number_strict, None) is None
    with pytest.raises(Exception, match="not a number: x"):
        one(spark, to_number_strict, "x")


def test_percent_of_nothing_is_null(spark):
    frame = spark.createDataFrame([(1, 4), (1, 0), (None, 3)], "a int, b int")
    got = [r[0] for r in frame.select(percent(F.col("a"), F.col("b"))).collect()]
    assert got == [25.0, None, None]


def test_clips_keep_null(spark):
    frame = spark.createDataFrame([(-2.0,), (3.0,), (None,)], "x double")
    got = frame.select(at_least_zero(F.col("x")), at_most_zero(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(0.0, -2.0), (3.0, 0.0), (None, None)]


def test_exact_sum(spark):
    frame = spark.createDataFrame([(0.1,)] * 10 + [(None,)], "x double")
    assert frame.agg(exact_sum(F.col("x"))).first()[0] == 1.0
    giant = spark.createDataFrame([(1e300,), (1.0,)], "x double")
    assert giant.agg(exact_sum(F.col("x"))).first()[0] == 1e300
    endless = spark.createDataFrame([(math.inf,), (1.0,)], "x double")
    assert endless.agg(exact_sum(F.col("x"))).first()[0] == math.inf
    assert frame.where("x > 5").agg(exact_sum(F.col("x"))).first()[0] is None


def test_to_time(spark):
    assert one(spark, to_time, "2024-01-05 07:08:09") == datetime(2024, 1, 5, 7, 8, 9)
    assert one(spark, to_time, "no time") is None
