"""Filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vitrine.functions.names import breadcrumb_path
from vitrine.functions.numbers import to_number
from vitrine.operators.filters import (
    between,
    drop_missing,
    in_any_category,
    in_days,
    in_stock,
    key_equals,
    on_day,
    since,
)
from vitrine.operators.panel import change, is_sale, with_previous
from vitrine.registry.book import query
from vitrine.registry.params import AS_OF, DAYS, SINCE_SQL, TARGET_SQL, TARGETS, TIE
from vitrine.registry.tables import Tables


@query("flt_lookback", f"SELECT url_id, price, created FROM observations WHERE {SINCE_SQL}")
def flt_lookback(t: Tables):
    return t.observations.where(since(F.col("created"), AS_OF, DAYS)).select(
        "url_id", "price", "created"
    )


@query(
    "flt_between",
    """SELECT url_id, price, created FROM clicks
    WHERE created >= TIMESTAMP '2024-01-05' AND created <= TIMESTAMP '2024-01-20'""",
)
def flt_between(t: Tables):
    return t.clicks.where(
        between(F.col("created"), date(2024, 1, 5), date(2024, 1, 20))
    ).select("url_id", "price", "created")


@query(
    "flt_half_open_day",
    """SELECT url_id, price, created FROM clicks
    WHERE created >= TIMESTAMP '2024-01-11' AND created < TIMESTAMP '2024-01-12'""",
)
def flt_half_open_day(t: Tables):
    return t.clicks.where(
        in_days(F.col("created"), date(2024, 1, 11), date(2024, 1, 12))
    ).select("url_id", "price", "created")


@query(
    "flt_date_eq",
    """SELECT url_id, price, created FROM clicks
    WHERE CAST(created AS DATE) = DATE '2024-01-17'""",
)
def flt_date_eq(t: Tables):
    return t.clicks.where(on_day(F.col("created"), date(2024, 1, 17))).select(
        "url_id", "price", "created"
    )


@query("flt_key_eq", "SELECT url_id, price, created FROM observations WHERE product_id = 'I42'")
def flt_key_eq(t: Tables):
    return t.observations.where(key_equals(F.col("product_id"), "I42")).select(
        "url_id", "price", "created"
    )


@query(
    "flt_post_left_join",
    """SELECT l.url, l.created AS listed, o.price, o.created
    FROM listings l LEFT JOIN observations o ON l.url = o.url_id
    WHERE l.created >= TIMESTAMP '1995-07-01' AND o.created >= TIMESTAMP '1999-07-01'""",
)
def flt_post_left_join(t: Tables):
    listings = t.listings.select("url", F.col("created").alias("listed"))
    joined = listings.join(t.observations, F.col("url") == F.col("url_id"), "left")
    return joined.where(
        (F.col("listed") >= F.lit(date(1995, 7, 1))) & since(F.col("created"), AS_OF, DAYS)
    ).select("url", "listed", "price", "created")


@query("flt_category_any", f"SELECT url, path FROM listings WHERE {TARGET_SQL}")
def flt_category_any(t: Tables):
    rows = t.listings.select("url", breadcrumb_path(F.col("breadcrumbs")).alias("path"))
    return rows.where(in_any_category(F.col("path"), TARGETS))


@query(
    "flt_drop_null",
    """SELECT url_id, CAST(q AS DOUBLE) AS quantity, created, l_orderkey, l_linenumber
    FROM observations WHERE q IS NOT NULL""",
)
def flt_drop_null(t: Tables):
    rows = t.observations.select(
        "url_id", to_number(F.col("available_quantity")).alias("quantity"), "created", *TIE
    )
    return drop_missing(rows, "quantity")


@query("flt_in_stock", "SELECT url_id, q AS quantity, created FROM clicks WHERE q > 0")
def flt_in_stock(t: Tables):
    rows = t.clicks.select(
        "url_id", to_number(F.col("available_quantity")).alias("quantity"), "created"
    )
    return rows.where(in_stock(F.col("quantity")))


@query(
    "flt_current_day",
    """SELECT url_id, available_quantity, created, l_orderkey, l_linenumber FROM observations
    WHERE CAST(created AS DATE) = DATE '2000-06-30'""",
)
def flt_current_day(t: Tables):
    return t.observations.where(on_day(F.col("created"), AS_OF)).select(
        "url_id", "available_quantity", "created", *TIE
    )


@query(
    "flt_flag",
    """SELECT url_id, created, quantity FROM (
      SELECT url_id, created, q AS quantity,
        q - lag(q) OVER (PARTITION BY url_id ORDER BY created) AS d FROM clicks)
    WHERE d < 0""",
)
def flt_flag(t: Tables):
    rows = t.clicks.select(
        "url_id", "created", to_number(F.col("available_quantity")).alias("quantity")
    )
    steps = with_previous(rows, ["url_id"], "created", [], {"before": "quantity"})
    flagged = steps.withColumn("sold", is_sale(change(F.col("quantity"), F.col("before"))))
    return flagged.where("sold").select("url_id", "created", "quantity")
