from __future__ import annotations

import os

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = "alpha beta, gamma\n" * 3000


@pytest.fixture(scope="session")
def workers(spark):
    """Local Python workers find the library."""
    spark.sparkContext.environment["PYTHONPATH"] = HERE
    return spark


ROWS = [
    (1, "The MIT license. The same words again and again", "a", "en"),
    (2, "the mit LICENSE. the same words again and again", "a", "en"),
    (3, None, "a", None),
    (4, "", None, "en"),
    (5, "   \n\t ", None, "en"),
    (6, "word", "b", "de"),
    (6, "word", "b", "de"),
    (None, "no id here at all", "b", "de"),
    (None, None, None, None),
    (7, LONG, "c", "en"),
    (8, "nul \x00 in \x1c between \x85 and　wide ñandú ΣΑΣ İstanbul 😀", "é", "es"),
    (9, "<|endoftext|> and <|endof", "z", "en"),
]
EXTRA = "shard int, Slot int, size int, score string, simhash int, position int, part int, before int, offset int, n_lines int, copy int, mix int, spaced int"


@pytest.fixture(scope="session")
def messy(workers):
    """Nulls in any column, empty and long texts, repeated rows, names that operators use too."""
    schema = f"doc_id long, text string, source string, lang string, n_chars long, {EXTRA}"
    tail = (0, 1, 2, "x", 4, 5, 6, 7, 8, 9, 10, 11, 12)
    rows = [(*row, len(row[1] or ""), *tail) for row in ROWS]
    return workers.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
