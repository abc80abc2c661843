"""Distinct, sort, pages, unions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from vitrine.functions.dates import day_text
from vitrine.functions.numbers import to_number
from vitrine.operators.filters import since
from vitrine.operators.ordering import (
    by_listing_newest_first,
    distinct_keys,
    latest,
    page,
    page_after,
    stack,
    sweep_days,
)
from vitrine.registry.book import query
from vitrine.registry.params import AS_OF, DAYS, TIE
from vitrine.registry.tables import Tables


@query(
    "distinct_keys",
    "SELECT DISTINCT url_id FROM observations WHERE created >= TIMESTAMP '1999-07-01'",
)
def distinct_keys_query(t: Tables):
    return distinct_keys(t.observations.where(since(F.col("created"), AS_OF, DAYS)), "url_id")


@query(
    "distinct_rows",
    """SELECT DISTINCT l.url, l.breadcrumbs, o.available_quantity, o.price,
      o.created AS product_created
    FROM listings l JOIN observations o ON l.url = o.url_id
    WHERE l.created >= TIMESTAMP '1995-07-01' AND o.created >= TIMESTAMP '1999-07-01'""",
)
def distinct_rows(t: Tables):
    listings = t.listings.where(F.col("created") >= F.lit(date(1995, 7, 1))).select(
        "url", "breadcrumbs"
    )
    facts = t.observations.where(since(F.col("created"), AS_OF, DAYS)).select(
        "url_id", "available_quantity", "price", F.col("created").alias("product_created")
    )
    return listings.join(facts, F.col("url") == F.col("url_id")).drop("url_id").distinct()


@query(
    "sort_multi_key",
    """SELECT url_id, created, l_orderkey, l_linenumber FROM observations
    ORDER BY url_id ASC, created DESC, l_orderkey, l_linenumber""",
)
def sort_multi_key(t: Tables):
    rows = t.observations.select("url_id", "created", *TIE)
    return by_listing_newest_first(rows, "url_id", "created", *TIE)


@query(
    "page_limit_offset",
    """SELECT url_id, created, l_orderkey, l_linenumber, price FROM observations
    ORDER BY url_id ASC, created DESC, l_orderkey, l_linenumber LIMIT 1000 OFFSET 2000""",
)
def page_limit_offset(t: Tables):
    rows = t.observations.select("url_id", "created", *TIE, "price")
    return page(rows, ["url_id", "created desc", *TIE], offset=2000, size=1000)


@query(
    "page_after_key",
    """SELECT url_id, created, l_orderkey, l_linenumber, price FROM observations
    WHERE url_id > 'P150' OR (url_id = 'P150' AND created < TIMESTAMP '1998-01-01')
    ORDER BY url_id ASC, created DESC, l_orderkey, l_linenumber LIMIT 1000""",
)
def page_after_key(t: Tables):
    """The page that follows a given place in the order."""
    rows = t.observations.select("url_id", "created", *TIE, "price")
    # Nothing has a key as large as this within its second.
    key = ("P150", datetime(1998, 1, 1), 2**62, 2**30)
    return page_after(rows, ["url_id", "created desc", *TIE], key, 1000)


@query(
    "topk_latest",
    """SELECT url_id, available_quantity, price, created FROM clicks
    ORDER BY created DESC LIMIT 500""",
)
def topk_latest(t: Tables):
    rows = t.clicks.select("url_id", "available_quantity", "price", "created")
    return latest(rows, 500, "created")


@query(
    "union_slices",
    """SELECT url_id, price, created FROM clicks
    UNION ALL SELECT url_id, TRY_CAST(price AS DOUBLE), created FROM observations""",
)
def union_slices(t: Tables):
    """Frames of different sources; days of one table are read by a sweep."""
    observations = t.observations.select(
        "url_id", to_number(F.col("price")).alias("price"), "created"
    )
    return stack([t.clicks.select("url_id", "price", "created"), observations])


@query(
    "union_day_sweep",
    """SELECT url_id, price, created, CAST(CAST(created AS DATE) AS VARCHAR) AS snapshot_date FROM clicks
    WHERE created >= TIMESTAMP '2024-01-03' AND created < TIMESTAMP '2024-02-03'""",
)
def union_day_sweep(t: Tables):
    rows = t.clicks.select("url_id", "price", "created")
    swept = sweep_days(rows, "created", date(2024, 1, 3), date(2024, 2, 3))
    return swept.withColumn("snapshot_date", day_text(F.col("snapshot_date")))
