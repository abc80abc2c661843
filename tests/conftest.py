from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitrine.operators.skew import SkewPolicy  # noqa: E402
from vitrine.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"

# Every key with more than a handful of rows is hot, and all rows are looked at.
EAGER = SkewPolicy(min_rows=3, oversplit=2)
OFF = SkewPolicy(enabled=False)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def micro_listings(spark):
    return spark.createDataFrame(
        [
            ("u1", '[{"name":"Electrónica"},{"name":"Audio"}]'),
            ("u2", '[{"name":"Computación"},null,{"name":"Tablets"}]'),
            ("u3", '[{"name":"Electrónica"},{"name":"Audio"}]'),
            ("u4", '[{"name":"Electrónica"},{"name":"Audio"}]'),
            ("u5", '[{"name":"Hogar"}]'),
            ("u6", "oops"),
        ],
        "url string, breadcrumbs string",
    )


@pytest.fixture(scope="session")
def micro_facts(spark):
    rows = [
        ("u1", datetime(2024, 1, 1, 8), 1, "10", "100.00"),
        ("u1", datetime(2024, 1, 2, 8), 2, "7", "110.00"),
        ("u1", datetime(2024, 1, 3, 8), 3, "12", "120.00"),
        ("u2", datetime(2024, 1, 1, 9), 4, "5", "50.00"),
        ("u2", datetime(2024, 1, 2, 9), 5, "2", "60.00"),
        ("u2", datetime(2024, 1, 3, 0), 6, "n/a", "60.00"),
        ("u2", datetime(2024, 1, 3, 9), 7, "2", ""),
        ("u3", datetime(2024, 1, 3, 10), 8, "4", "9.99"),
        ("u5", datetime(2024, 1, 2, 10), 9, "1", "1.00"),
    ]
    return spark.createDataFrame(
        rows,
        "url_id string, created timestamp_ntz, id long, available_quantity string, price string",
    )


def rows_of(frame):
    """Rows as a sorted list of tuples, columns in order of name."""
    return sorted(
        (tuple(row) for row in frame.select(*sorted(frame.columns)).collect()), key=repr
    )
