"""The reports."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from vitrine.functions.dates import day_text
from vitrine.functions.names import breadcrumb_names
from vitrine.functions.numbers import to_number
from vitrine.plans.coverage import brand_seller_report, raw_brand_report, seller_price_report
from vitrine.plans.extracts import filtered_extract, product_history
from vitrine.plans.histories import FlowRules
from vitrine.plans.price import price_report, price_report_by_product
from vitrine.plans.stock_flow import (
    changed_products_report,
    stock_flow_by_ancestor,
    stock_flow_draft_report,
    stock_flow_report,
)
from vitrine.registry.book import query, rounded
from vitrine.registry.params import EVERYTHING, SCOPE, SINCE_SQL, SLICED, TARGET_SQL, TIE
from vitrine.registry.scans import csv_listings_and_observations
from vitrine.registry.tables import Tables

_WINDOW = "OVER (PARTITION BY url ORDER BY created, l_orderkey, l_linenumber)"


_SCOPED_SQL = f"""scoped AS (
      SELECT l.url, l.path, l.last_name, l.path_cased, l.brands, l.seller_id,
        o.created, o.l_orderkey, o.l_linenumber, o.q, o.p
      FROM (SELECT * FROM listings WHERE {TARGET_SQL}) l
      JOIN (SELECT * FROM observations WHERE {SINCE_SQL} AND q IS NOT NULL) o ON l.url = o.url_id)"""


def _price_sql(category: str) -> str:
    return f"""WITH {_SCOPED_SQL}
    SELECT {category} AS category, min(CAST(p AS DOUBLE)) AS min_price,
      max(CAST(p AS DOUBLE)) AS max_price, CAST(sum(p) AS DOUBLE) / count(p) AS avg_price,
      round(median(CAST(p AS DOUBLE)), 4) AS median_price
    FROM scoped GROUP BY ALL"""


@query("report_price", _price_sql("path"))
def report_price(t: Tables):
    report = price_report(t.listings, t.observations, SCOPE)
    return rounded(report, "median_price")


@query("report_price_last_category", _price_sql("lower(last_name)"))
def report_price_last_category(t: Tables):
    report = price_report(t.listings, t.observations, SCOPE, level="last")
    return rounded(report, "median_price")


@query(
    "report_price_product",
    """SELECT l.product_id, l.breadcrumbs AS category, min(CAST(p AS DOUBLE)) AS min_price,
      max(CAST(p AS DOUBLE)) AS max_price, CAST(sum(p) AS DOUBLE) / count(p) AS mean_price,
      round(median(CAST(p AS DOUBLE)), 4) AS median_price
    FROM listings l JOIN observations o ON l.url = o.url_id
    WHERE l.breadcrumbs IS NOT NULL
      AND o.created >= TIMESTAMP '2000-01-15' AND o.created <= TIMESTAMP '2000-02-15'
    GROUP BY ALL""",
)
def report_price_product(t: Tables):
    report = price_report_by_product(
        t.listings, t.observations, date(2000, 1, 15), date(2000, 2, 15)
    )
    return rounded(report, "median_price")


@query(
    "report_brand_seller",
    f"""WITH {_SCOPED_SQL},
    steps AS (SELECT url, path_cased, brands, seller_id, q - lag(q) {_WINDOW} AS d
      FROM scoped WHERE seller_id IN (SELECT seller_id FROM sellers)),
    bs AS (
      SELECT path_cased AS categories, brand, seller_id, coalesce(bool_or(d < 0), false) AS sold
      FROM (SELECT path_cased, unnest(brands) AS brand, seller_id, d FROM steps) GROUP BY ALL),
    b AS (SELECT categories, brand, bool_or(sold) AS sold FROM bs GROUP BY ALL),
    bc AS (SELECT categories, count(*) FILTER (WHERE sold) AS brands_with_sales,
      count(*) AS total_brands FROM b GROUP BY categories),
    sc AS (SELECT categories, count(DISTINCT seller_id) AS sellers_count,
      CAST(nullif(count(DISTINCT CASE WHEN sold THEN seller_id END), 0) AS DOUBLE) AS sellers_with_sales_count
      FROM bs GROUP BY categories)
    SELECT categories, brands_with_sales, total_brands,
      brands_with_sales / total_brands * 100 AS pct_brands_with_sales,
      sellers_count, sellers_with_sales_count,
      sellers_with_sales_count / sellers_count * 100 AS pct_sellers_with_sales
    FROM bc JOIN sc USING (categories)""",
)
def report_brand_seller(t: Tables):
    report = brand_seller_report(t.listings, t.observations, t.sellers, SCOPE)
    return report.withColumn(
        "sellers_with_sales_count", F.col("sellers_with_sales_count").cast("double")
    )


@query(
    "report_brand_raw",
    """WITH steps AS (
      SELECT l.path_cased AS category, l.brand,
        coalesce(o.q, 0) - lag(coalesce(o.q, 0)) OVER (PARTITION BY l.url
          ORDER BY o.created, o.l_orderkey, o.l_linenumber) AS d
      FROM listings l LEFT JOIN observations o ON l.url = o.url_id),
    b AS (SELECT category, brand, coalesce(bool_or(d < 0), false) AS sold FROM steps
      WHERE category IS NOT NULL AND brand IS NOT NULL GROUP BY ALL)
    SELECT category, count(DISTINCT brand) AS total_brands,
      count(*) FILTER (WHERE sold) AS brands_with_sales,
      count(*) FILTER (WHERE sold) / count(DISTINCT brand) * 100 AS pct_brands_with_sales
    FROM b GROUP BY category""",
)
def report_brand_raw(t: Tables):
    return raw_brand_report(t.listings, t.observations, EVERYTHING)


@query(
    "report_seller_price",
    """WITH steps AS (
      SELECT l.url, l.names, l.seller_id, o.p,
        coalesce(o.q, 0) - lag(coalesce(o.q, 0)) OVER w AS d,
        first_value(CAST(o.p AS DOUBLE)) OVER (PARTITION BY l.url
          ORDER BY o.created DESC, o.l_orderkey DESC, o.l_linenumber DESC) AS last_price
      FROM listings l LEFT JOIN observations o ON l.url = o.url_id
      WINDOW w AS (PARTITION BY l.url ORDER BY o.created, o.l_orderkey, o.l_linenumber)),
    x AS (SELECT unnest(names) AS category, seller_id, p, d, last_price FROM steps)
    SELECT category, min(last_price) AS min_price, count(DISTINCT seller_id) AS total_sellers,
      count(DISTINCT CASE WHEN d < 0 THEN seller_id END) AS sellers_with_sales,
      count(DISTINCT CASE WHEN d < 0 THEN seller_id END) / count(DISTINCT seller_id) * 100
        AS pct_sellers_with_sales,
      CAST(max(p) AS DOUBLE) AS max_price, CAST(sum(p) AS DOUBLE) / count(p) AS avg_price,
      round(median(CAST(p AS DOUBLE)), 4) AS median_price
    FROM x GROUP BY category""",
)
def report_seller_price(t: Tables):
    report = seller_price_report(t.listings, t.observations, EVERYTHING)
    return rounded(report, "median_price")


def _flow_sql(first: str, unit: str) -> str:
    def counted(condition: str) -> str:
        if unit == "product":
            return f"count(DISTINCT CASE WHEN {condition} THEN url END)"
        return f"count(*) FILTER (WHERE {condition})"

    return f"""WITH {_SCOPED_SQL},
    steps AS (SELECT path AS category, url, created, q, p, q - lag(q) {_WINDOW} AS d,
      lag(p) {_WINDOW} AS pp FROM scoped),
    m AS (SELECT category, count(DISTINCT url) AS total_products,
      {counted(first)} AS products_with_movement, {counted('d < 0')} AS products_with_sales,
      count(DISTINCT CASE WHEN q > 0 THEN url END) AS products_with_available_quantity,
      round(CAST(greatest(coalesce(sum((pp + p) * -d), 0), 0) AS DOUBLE) / 2, 4) AS revenue,
      CAST(sum(q) FILTER (WHERE CAST(created AS DATE) = DATE '2000-06-30') AS DOUBLE) AS total_stock
      FROM steps GROUP BY ALL)
    SELECT category, total_products, products_with_movement, products_with_sales,
      products_with_movement / total_products * 100 AS pct_with_movement,
      products_with_sales / total_products * 100 AS pct_with_sales,
      products_with_available_quantity, revenue, total_stock
    FROM m"""


@query("report_stock_flow", _flow_sql("d IS NULL OR d <> 0", "event"))
def report_stock_flow(t: Tables):
    return rounded(stock_flow_report(t.listings, t.observations, SCOPE), "revenue")


@query("report_stock_flow_sliced", _flow_sql("d IS NULL OR d <> 0", "event"))
def report_stock_flow_sliced(t: Tables):
    """The same with every listing cut into slices, as hot ones are."""
    return rounded(
        stock_flow_report(t.listings, t.observations, replace(SCOPE, skew=SLICED)), "revenue"
    )


@query("report_stock_flow_products", _flow_sql("d <> 0", "product"))
def report_stock_flow_products(t: Tables):
    rules = FlowRules(first_counts=False, unit="product")
    return rounded(stock_flow_report(t.listings, t.observations, SCOPE, rules), "revenue")


@query(
    "report_stock_flow_draft",
    f"""WITH steps AS (
      SELECT l.path AS category, l.url, o.q, o.p,
        coalesce(o.q - lag(o.q) OVER (PARTITION BY l.url
          ORDER BY o.created, o.l_orderkey, o.l_linenumber), 0) AS d
      FROM (SELECT * FROM listings WHERE {TARGET_SQL}) l
      LEFT JOIN observations o ON l.url = o.url_id AND o.{SINCE_SQL}),
    m AS (SELECT category, count(DISTINCT url) AS total_products,
      count(*) FILTER (WHERE d <> 0) AS products_with_movement,
      count(*) FILTER (WHERE d < 0) AS products_with_sales,
      CAST(coalesce(sum(q), 0) AS DOUBLE) AS total_stock,
      count(DISTINCT CASE WHEN q > 0 THEN url END) AS products_with_available_quantity,
      round(CAST(coalesce(sum(p), 0) AS DOUBLE), 4) AS revenue,
      CAST(abs(sum(least(d, 0))) AS DOUBLE) AS units_sold
      FROM steps GROUP BY category)
    SELECT category, total_products, products_with_movement, products_with_sales, total_stock,
      products_with_movement / total_products * 100 AS pct_with_movement,
      products_with_sales / total_products * 100 AS pct_with_sales,
      products_with_available_quantity, revenue, units_sold
    FROM m""",
)
def report_stock_flow_draft(t: Tables):
    return rounded(stock_flow_draft_report(t.listings, t.observations, SCOPE), "revenue")


@query(
    "report_stock_flow_ancestors",
    """WITH steps AS (
      SELECT l.names, l.url, coalesce(o.q, 0) AS q, o.p,
        coalesce(coalesce(o.q, 0) - lag(coalesce(o.q, 0)) OVER (PARTITION BY l.url
          ORDER BY o.created, o.l_orderkey, o.l_linenumber), 0) AS d
      FROM listings l JOIN observations o ON l.url = o.url_id),
    x AS (SELECT unnest(names) AS category, url, q, p, d FROM steps),
    m AS (SELECT category, count(DISTINCT url) AS total_products,
      count(*) FILTER (WHERE d <> 0) AS products_with_movement,
      count(*) FILTER (WHERE d < 0) AS products_with_sales,
      count(*) FILTER (WHERE q > 0) AS observations_in_stock,
      CAST(sum(q) AS DOUBLE) AS total_stock,
      round(CAST(coalesce(sum(p), 0) AS DOUBLE), 4) AS revenue,
      CAST(abs(sum(least(d, 0))) AS DOUBLE) AS units_sold
      FROM x GROUP BY category)
    SELECT category, total_products, products_with_movement, products_with_sales,
      products_with_movement / total_products * 100 AS pct_with_movement,
      products_with_sales / total_products * 100 AS pct_with_sales,
      observations_in_stock, total_stock, revenue, units_sold
    FROM m""",
)
def report_stock_flow_ancestors(t: Tables):
    return rounded(stock_flow_by_ancestor(t.listings, t.observations, EVERYTHING), "revenue")


_CHANGED_SQL = """WITH steps AS (SELECT url_id, q - lag(q) OVER (PARTITION BY url_id
        ORDER BY created, l_orderkey, l_linenumber) AS d FROM observations),
    c AS (SELECT url_id, coalesce(bool_or(d <> 0), false) AS changed FROM steps GROUP BY url_id)
    SELECT category, count(DISTINCT url) AS count_of_products,
      count(DISTINCT CASE WHEN changed THEN url END) AS changed_products
    FROM (SELECT url, unnest(names) AS category FROM listings) l JOIN c ON l.url = c.url_id
    GROUP BY category"""


@query("report_changed_products", _CHANGED_SQL)
def report_changed_products(t: Tables):
    listings, observations = csv_listings_and_observations(t)
    return changed_products_report(listings, observations, EVERYTHING)


@query("report_changed_products_tables", _CHANGED_SQL)
def report_changed_products_tables(t: Tables):
    """The same straight from the tables."""
    listings = t.listings.select("url", breadcrumb_names(F.col("breadcrumbs")).alias("breadcrumbs"))
    observations = t.observations.select(
        "url_id", "created", *TIE, to_number(F.col("available_quantity")).alias("available_quantity")
    )
    return changed_products_report(listings, observations, EVERYTHING)


@query(
    "extract_filtered",
    f"""SELECT l.url, l.path AS categories, lower(l.last_name) AS last_category,
      CAST(o.q AS DOUBLE) AS available_quantity, CAST(o.p AS DOUBLE) AS price,
      o.created AS product_created, CAST(CAST(o.created AS DATE) AS VARCHAR) AS snapshot_date
    FROM (SELECT * FROM listings WHERE {TARGET_SQL}) l JOIN observations o ON l.url = o.url_id
    WHERE o.q IS NOT NULL AND o.created >= TIMESTAMP '2000-01-03'
      AND o.created < TIMESTAMP '2000-07-03'""",
)
def extract_filtered(t: Tables):
    extract = filtered_extract(
        t.listings, t.observations, date(2000, 1, 3), date(2000, 7, 3), SCOPE
    )
    return extract.withColumn("snapshot_date", day_text(F.col("snapshot_date")))


@query(
    "extract_product_history",
    """SELECT l.url, l.breadcrumbs, o.available_quantity, o.price, o.created AS product_created
    FROM (SELECT * FROM listings WHERE product_id = 'I42') l
    LEFT JOIN (SELECT * FROM observations WHERE product_id = 'I42'
      AND created >= TIMESTAMP '1996-01-15' AND created <= TIMESTAMP '2000-02-15') o
      ON l.url = o.url_id
    ORDER BY l.url, o.created DESC""",
)
def extract_product_history(t: Tables):
    return product_history(
        t.listings, t.observations, "I42", date(1996, 1, 15), date(2000, 2, 15)
    )
