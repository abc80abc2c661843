"""Projections and scalar functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vitrine.functions.dates import day_text, lookback_start, shift_days, to_time
from vitrine.functions.names import brand_names, breadcrumb_names, breadcrumb_path, last_name
from vitrine.functions.numbers import (
    at_least_zero,
    at_most_zero,
    exact_sum,
    or_zero,
    percent,
    to_number,
    to_number_strict,
)
from vitrine.operators.expand import per_element
from vitrine.operators.panel import change, is_sale, with_previous
from vitrine.registry.book import bigint, query, rounded
from vitrine.registry.params import TIE
from vitrine.registry.tables import Tables


@query("json_path_lower", "SELECT url, path FROM listings")
def json_path_lower(t: Tables):
    return t.listings.select("url", breadcrumb_path(F.col("breadcrumbs")).alias("path"))


@query("json_path_cased", "SELECT url, path_cased AS path FROM listings")
def json_path_cased(t: Tables):
    return t.listings.select(
        "url", breadcrumb_path(F.col("breadcrumbs"), lower=False).alias("path")
    )


def _list_text(column):
    return F.array_join(column, "|"), F.coalesce(bigint(F.size(column)), F.lit(-1))


@query(
    "json_names_array",
    "SELECT url, array_to_string(names, '|') AS names, coalesce(len(names), -1) AS n FROM listings",
)
def json_names_array(t: Tables):
    text, size = _list_text(breadcrumb_names(F.col("breadcrumbs")))
    return t.listings.select("url", text.alias("names"), size.alias("n"))


@query(
    "json_brand_array",
    "SELECT url, array_to_string(brands, '|') AS brands, coalesce(len(brands), -1) AS n FROM listings",
)
def json_brand_array(t: Tables):
    text, size = _list_text(brand_names(F.col("brand")))
    return t.listings.select("url", text.alias("brands"), size.alias("n"))


@query(
    "num_coerce",
    """SELECT url_id, CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) AS price,
    l_orderkey, l_linenumber, created FROM observations""",
)
def num_coerce(t: Tables):
    return t.observations.select(
        "url_id",
        to_number(F.col("available_quantity")).alias("quantity"),
        to_number(F.col("price")).alias("price"),
        *TIE,
        "created",
    )


@query("num_strict", "SELECT url_id, created, q AS quantity FROM clicks")
def num_strict(t: Tables):
    return t.clicks.select(
        "url_id", "created", to_number_strict(F.col("available_quantity")).alias("quantity")
    )


@query(
    "num_fill_zero",
    """SELECT url_id, CAST(coalesce(q, 0) AS DOUBLE) AS quantity, l_orderkey, l_linenumber, created
    FROM observations""",
)
def num_fill_zero(t: Tables):
    return t.observations.select(
        "url_id",
        or_zero(to_number(F.col("available_quantity"))).alias("quantity"),
        *TIE,
        "created",
    )


@query("last_category", "SELECT url, last_name AS last_category FROM listings")
def last_category(t: Tables):
    return t.listings.select(
        "url", last_name(breadcrumb_names(F.col("breadcrumbs"))).alias("last_category")
    )


@query("prj_rename", "SELECT url_id AS url, price, created AS product_created FROM observations")
def prj_rename(t: Tables):
    return (
        t.observations.select("url_id", "price", "created")
        .withColumnRenamed("url_id", "url")
        .withColumnRenamed("created", "product_created")
    )


@query("prj_drop", "SELECT url, product_id, seller_id, created FROM listings")
def prj_drop(t: Tables):
    return t.listings.drop("breadcrumbs", "brand")


@query(
    "num_percent",
    """SELECT category, n_sold, n,
      n_sold / n * 100 AS pct
    FROM (SELECT category, count(*) FILTER (WHERE q = 0) AS n_sold, count(*) AS n
      FROM clicks GROUP BY category)""",
)
def num_percent(t: Tables):
    counts = (
        t.clicks.withColumn("q", to_number(F.col("available_quantity")))
        .groupBy("category")
        .agg(F.count_if(F.col("q") == 0).alias("n_sold"), F.count(F.lit(1)).alias("n"))
    )
    return counts.withColumn("pct", percent(F.col("n_sold"), F.col("n")))


@query(
    "num_clip_abs",
    """SELECT url_id, created, greatest(q - 50, 0) AS above, least(q - 50, 0) AS below,
    abs(q - 50) AS size FROM clicks""",
)
def num_clip_abs(t: Tables):
    difference = to_number(F.col("available_quantity")) - 50
    return t.clicks.select(
        "url_id",
        "created",
        at_least_zero(difference).alias("above"),
        at_most_zero(difference).alias("below"),
        F.abs(difference).alias("size"),
    )


@query(
    "num_least_zero",
    """SELECT url_id, created, least(d, 0) AS sold FROM (
      SELECT url_id, created,
        coalesce(q - lag(q) OVER (PARTITION BY url_id ORDER BY created), 0) AS d FROM clicks)""",
)
def num_least_zero(t: Tables):
    rows = t.clicks.select(
        "url_id", "created", to_number(F.col("available_quantity")).alias("quantity")
    )
    steps = with_previous(
        rows, ["url_id"], "created", [], {"before": "quantity"}, null_keys=False
    )
    moved = change(F.col("quantity"), F.col("before"), first=0)
    return steps.select("url_id", "created", at_most_zero(moved).alias("sold"))


@query(
    "ts_parse",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS parsed, l_quantity FROM lineitem""",
)
def ts_parse(t: Tables):
    text = t.table("lineitem").withColumn(
        "shipped", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    )
    return text.select(
        "l_orderkey", "l_linenumber", "l_partkey", to_time(F.col("shipped")).alias("parsed"), "l_quantity"
    )


@query(
    "date_arith",
    """SELECT url_id, created, CAST(CAST(created AS DATE) - 30 AS VARCHAR) AS month_before,
      CAST(CAST(created AS DATE) + 1 AS VARCHAR) AS next_day, strftime(created, '%Y-%m-%d') AS day,
      CAST(created AS DATE) >= DATE '2023-12-18' AS in_window
    FROM clicks""",
)
def date_arith(t: Tables):
    day = F.to_date("created")
    return t.clicks.select(
        "url_id",
        "created",
        day_text(shift_days(day, -30)).alias("month_before"),
        day_text(shift_days(day, 1)).alias("next_day"),
        day_text(day).alias("day"),
        (day >= F.lit(lookback_start(date(2024, 1, 17), 30))).alias("in_window"),
    )


@query(
    "bool_to_int",
    """SELECT url_id, created, CASE WHEN d < 0 THEN 1 ELSE 0 END AS sold FROM (
      SELECT url_id, created, q - lag(q) OVER (PARTITION BY url_id ORDER BY created) AS d
      FROM clicks)""",
)
def bool_to_int(t: Tables):
    rows = t.clicks.select(
        "url_id", "created", to_number(F.col("available_quantity")).alias("quantity")
    )
    steps = with_previous(
        rows, ["url_id"], "created", [], {"before": "quantity"}, null_keys=False
    )
    sold = is_sale(change(F.col("quantity"), F.col("before")))
    return steps.select("url_id", "created", sold.cast("int").alias("sold"))


@query(
    "map_lookup",
    """SELECT o.url_id, o.created, o.l_orderkey, o.l_linenumber, x.category, r.revenue
    FROM observations o
    JOIN (SELECT url, unnest(names) AS category FROM listings) x ON o.url_id = x.url
    LEFT JOIN (
      SELECT category, round(CAST(sum(p) AS DOUBLE), 4) AS revenue
      FROM observations JOIN (SELECT url, unnest(names) AS category FROM listings) y
        ON url_id = y.url
      GROUP BY category) r ON r.category = x.category""",
)
def map_lookup(t: Tables):
    """Revenue is found per listing first, and spread over the listing's categories."""
    listed = per_element(
        t.listings.select("url", breadcrumb_names(F.col("breadcrumbs")).alias("category")),
        "category",
    ).where(F.col("category").isNotNull())
    price = to_number(F.col("price"))
    per_listing = t.observations.groupBy("url_id").agg(exact_sum(price).alias("sold_for"))
    revenue = (
        listed.join(per_listing, F.col("url") == F.col("url_id"))
        .groupBy("category")
        .agg(exact_sum(F.col("sold_for")).alias("revenue"))
    )
    valued = listed.join(revenue, "category", "left")
    facts = t.observations.select("url_id", "created", *TIE)
    rows = valued.join(facts, F.col("url") == F.col("url_id")).drop("url")
    return rounded(rows, "revenue")
