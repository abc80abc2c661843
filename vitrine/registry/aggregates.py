"""Aggregates per category."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from vitrine.functions.names import brand_names, breadcrumb_names, breadcrumb_path
from vitrine.functions.numbers import exact_sum, to_number
from vitrine.operators.expand import per_distinct_element, per_element
from vitrine.operators.filters import on_day
from vitrine.operators.measures import any_by, count_distinct_by, coverage, stock_flow_by
from vitrine.operators.panel import change, is_movement, is_sale, with_previous
from vitrine.operators.stats import price_stats
from vitrine.plans.inputs import target_listings
from vitrine.plans.price import price_report_by_product
from vitrine.plans.histories import FINAL_RULES, FlowRules, listing_totals
from vitrine.registry.book import query, rounded
from vitrine.registry.params import AS_OF, EVERYTHING, TIE
from vitrine.registry.tables import Tables



def _prices_sql(key: str, rows: str) -> str:
    return f"""SELECT {key}, min(CAST(p AS DOUBLE)) AS min_price, max(CAST(p AS DOUBLE)) AS max_price,
      CAST(sum(p) AS DOUBLE) / count(p) AS avg_price,
      round(median(CAST(p AS DOUBLE)), 4) AS median_price
    FROM {rows} GROUP BY ALL"""


def _priced(t: Tables, *columns):
    """Observations with a readable quantity, their price and columns of the listing."""
    facts = t.observations.where(to_number(F.col("available_quantity")).isNotNull()).select(
        "url_id", "created", *TIE, to_number(F.col("price")).alias("price")
    )
    return t.listings.select("url", *columns).join(facts, F.col("url") == F.col("url_id"))


_JOINED_SQL = "listings JOIN observations ON url = url_id WHERE q IS NOT NULL"


@query(
    "agg_price_by_last_category",
    _prices_sql("last_name AS category", f"{_JOINED_SQL} AND last_name IS NOT NULL"),
)
def agg_price_by_last_category(t: Tables):
    last = F.try_element_at(breadcrumb_names(F.col("breadcrumbs")), F.lit(-1))
    return rounded(price_stats(_priced(t, last.alias("category")), ["category"]), "median_price")


@query(
    "agg_price_by_path",
    _prices_sql("path AS category", f"{_JOINED_SQL} AND path IS NOT NULL"),
)
def agg_price_by_path(t: Tables):
    path = breadcrumb_path(F.col("breadcrumbs"))
    return rounded(price_stats(_priced(t, path.alias("category")), ["category"]), "median_price")


@query(
    "agg_price_by_raw",
    _prices_sql("breadcrumbs AS category", f"{_JOINED_SQL} AND breadcrumbs IS NOT NULL"),
)
def agg_price_by_raw(t: Tables):
    rows = _priced(t, F.col("breadcrumbs").alias("category"))
    return rounded(price_stats(rows, ["category"]), "median_price")


@query(
    "agg_price_by_product",
    """SELECT l.product_id, l.breadcrumbs AS category, min(CAST(p AS DOUBLE)) AS min_price,
      max(CAST(p AS DOUBLE)) AS max_price, CAST(sum(p) AS DOUBLE) / count(p) AS mean_price,
      round(median(CAST(p AS DOUBLE)), 4) AS median_price
    FROM listings l JOIN observations o ON l.url = o.url_id
    WHERE l.breadcrumbs IS NOT NULL
      AND o.created >= TIMESTAMP '1996-01-15' AND o.created <= TIMESTAMP '1999-02-15'
    GROUP BY ALL""",
)
def agg_price_by_product(t: Tables):
    report = price_report_by_product(
        t.listings, t.observations, date(1996, 1, 15), date(1999, 2, 15)
    )
    return rounded(report, "median_price")


@query(
    "agg_price_last_mixed",
    """WITH x AS (SELECT l.path AS category, o.p,
        first_value(o.p) OVER (PARTITION BY o.url_id
          ORDER BY o.created DESC, o.l_orderkey DESC, o.l_linenumber DESC) AS last_price
      FROM listings l JOIN observations o ON l.url = o.url_id
      WHERE o.q IS NOT NULL AND l.path IS NOT NULL)
    SELECT category, CAST(min(last_price) AS DOUBLE) AS min_price,
      CAST(max(p) AS DOUBLE) AS max_price, CAST(sum(p) AS DOUBLE) / count(p) AS avg_price,
      round(median(CAST(p AS DOUBLE)), 4) AS median_price
    FROM x GROUP BY category""",
)
def agg_price_last_mixed(t: Tables):
    """One pass: prices are counted per listing, which also keeps the listing's last one."""
    facts = t.observations.where(to_number(F.col("available_quantity")).isNotNull())
    price = to_number(F.col("price")).alias("price")
    counted = facts.groupBy("url_id", price).agg(
        F.count(F.lit(1)).alias("times"), F.max(F.struct("created", *TIE)).alias("at")
    )
    listing = Window.partitionBy("url_id")
    last = F.max(F.struct("at", "price")).over(listing)["price"].alias("last_price")
    listed = t.listings.select("url", breadcrumb_path(F.col("breadcrumbs")).alias("category"))
    rows = counted.select("url_id", "price", "times", last).join(
        listed, F.col("url") == F.col("url_id")
    )
    prices = price_stats(
        rows,
        ["category"],
        weight="times",
        names=("_low", "max_price", "avg_price", "median_price"),
        more={"min_price": (F.min, "last_price")},
    ).drop("_low")
    return rounded(prices, "median_price")


@query(
    "agg_distinct_products_brand",
    """SELECT category, brand, count(DISTINCT url) AS total_products
    FROM (SELECT url, path AS category, unnest(brands) AS brand FROM listings
      WHERE path IS NOT NULL AND url IN (SELECT url_id FROM observations WHERE q IS NOT NULL))
    GROUP BY ALL""",
)
def agg_distinct_products_brand(t: Tables):
    """Distinct products per category and brand."""
    path = breadcrumb_path(F.col("breadcrumbs")).alias("category")
    listed = t.listings.select("url", path, brand_names(F.col("brand")).alias("brand"))
    seen = t.observations.where(to_number(F.col("available_quantity")).isNotNull())
    rows = per_element(
        listed.join(seen.select("url_id"), F.col("url") == F.col("url_id"), "left_semi"), "brand"
    )
    return count_distinct_by(rows, ["category", "brand"], "url", "total_products")


@query(
    "agg_distinct_products",
    """SELECT path AS category, count(DISTINCT url) AS total_products
    FROM listings JOIN observations ON url = url_id
    WHERE q IS NOT NULL AND path IS NOT NULL GROUP BY ALL""",
)
def agg_distinct_products(t: Tables):
    rows = _priced(t, breadcrumb_path(F.col("breadcrumbs")).alias("category"))
    return count_distinct_by(rows, ["category"], "url", "total_products")


@query(
    "agg_distinct_brands",
    """SELECT category, count(DISTINCT brand) AS unique_brands_count
    FROM (SELECT category, unnest(CASE WHEN brands IS NULL OR len(brands) = 0 THEN [NULL]
        ELSE brands END) AS brand
      FROM (SELECT brands, unnest(names) AS category FROM listings)) GROUP BY category""",
)
def agg_distinct_brands(t: Tables):
    rows = t.listings.select(
        breadcrumb_names(F.col("breadcrumbs")).alias("names"),
        brand_names(F.col("brand")).alias("brands"),
    )
    categories = per_distinct_element(rows, "names", "category", "_times")
    brands = categories.withColumn("brand", F.explode_outer("brands"))
    return count_distinct_by(brands, ["category"], "brand", "unique_brands_count")


@query(
    "agg_distinct_sellers",
    """SELECT category, count(DISTINCT seller_id) AS sellers_count
    FROM (SELECT seller_id, unnest(names) AS category FROM listings) GROUP BY category""",
)
def agg_distinct_sellers(t: Tables):
    rows = t.listings.select(
        "seller_id", breadcrumb_names(F.col("breadcrumbs")).alias("names")
    )
    categories = per_distinct_element(rows, "names", "category", "_times")
    return count_distinct_by(categories, ["category"], "seller_id", "sellers_count")


_STEP_WINDOW = "OVER (PARTITION BY url ORDER BY created, l_orderkey, l_linenumber)"
_FLOW_SQL = f"""steps AS (
  SELECT path AS category, url, seller_id, brands, created, q, p,
    q - lag(q) {_STEP_WINDOW} AS d, lag(p) {_STEP_WINDOW} AS pp
  FROM (SELECT l.url, l.path, l.seller_id, l.brands, o.created, o.l_orderkey, o.l_linenumber,
      o.q, o.p
    FROM listings l JOIN observations o ON l.url = o.url_id
    WHERE q IS NOT NULL AND path IS NOT NULL AND path <> ''))"""


def _flow(t: Tables, rules: FlowRules = FINAL_RULES, unit: str = "event"):
    """Totals per category path over all observations, stock of the report date included."""
    listings = target_listings(t.listings, EVERYTHING).where(F.col("category") != "")
    per_listing = listing_totals(listings, t.observations, EVERYTHING, rules, today=AS_OF)
    return stock_flow_by(per_listing, ["category"], unit)


@query(
    "agg_movement",
    f"""WITH {_FLOW_SQL} SELECT category,
      count(*) FILTER (WHERE d IS NULL OR d <> 0) AS products_with_movement FROM steps GROUP BY ALL""",
)
def agg_movement(t: Tables):
    return _flow(t).select("category", "products_with_movement")


@query(
    "agg_sales",
    f"""WITH {_FLOW_SQL} SELECT category,
      count(*) FILTER (WHERE d < 0) AS products_with_sales FROM steps GROUP BY ALL""",
)
def agg_sales(t: Tables):
    return _flow(t).select("category", "products_with_sales")


@query(
    "agg_sales_by_product",
    f"""WITH {_FLOW_SQL} SELECT category, count(DISTINCT url) AS total_products,
      count(DISTINCT CASE WHEN d <> 0 THEN url END) AS products_with_movement,
      count(DISTINCT CASE WHEN d < 0 THEN url END) AS products_with_sales
    FROM steps GROUP BY ALL""",
)
def agg_sales_by_product(t: Tables):
    rules = FlowRules(first_counts=False)
    return _flow(t, rules, "product").select(
        "category", "total_products", "products_with_movement", "products_with_sales"
    )


def _sold(t: Tables, *keep: Column):
    """Whether a listing ever sold, with its category path and seller."""
    listings = target_listings(t.listings, EVERYTHING, keep=("seller_id", *keep))
    totals = listing_totals(
        listings.where(F.col("category") != ""), t.observations, EVERYTHING, FINAL_RULES
    )
    return totals.withColumn("sold", F.col("sales") > 0)


def _sold_brands(t: Tables):
    """The same, one row per brand of the listing. Listings are read and parsed once."""
    sold = _sold(t, brand_names(F.col("brand")).alias("brands"))
    return per_distinct_element(sold.select("category", "seller_id", "brands", "sold"), "brands", "brand", "_times")


@query(
    "agg_any_brand",
    f"""WITH {_FLOW_SQL} SELECT category, brand, coalesce(bool_or(d < 0), false) AS sale_detected
    FROM (SELECT category, unnest(brands) AS brand, d FROM steps) GROUP BY ALL""",
)
def agg_any_brand(t: Tables):
    rows = _sold_brands(t)
    return any_by(rows, ["category", "brand"], F.col("sold"), "sale_detected")


@query(
    "agg_any_brand_seller",
    f"""WITH {_FLOW_SQL} SELECT category, brand, seller_id,
      coalesce(bool_or(d < 0), false) AS sale_detected
    FROM (SELECT category, unnest(brands) AS brand, seller_id, d FROM steps) GROUP BY ALL""",
)
def agg_any_brand_seller(t: Tables):
    rows = _sold_brands(t)
    return any_by(rows, ["category", "brand", "seller_id"], F.col("sold"), "sale_detected")


@query(
    "agg_brand_coverage",
    f"""WITH {_FLOW_SQL}, b AS (
      SELECT category, brand, coalesce(bool_or(d < 0), false) AS sold
      FROM (SELECT category, unnest(brands) AS brand, d FROM steps) GROUP BY ALL)
    SELECT category, count(*) AS total_brands, count(*) FILTER (WHERE sold) AS brands_with_sales,
      count(*) FILTER (WHERE sold) / count(*) * 100 AS pct_brands_with_sales
    FROM b GROUP BY category""",
)
def agg_brand_coverage(t: Tables):
    rows = _sold_brands(t)
    flagged = any_by(rows, ["category", "brand"], F.col("sold"), "sold")
    names = ("total_brands", "brands_with_sales", "pct_brands_with_sales")
    return coverage(flagged, ["category"], "sold", *names)


@query(
    "agg_seller_coverage",
    f"""WITH {_FLOW_SQL}, s AS (
      SELECT category, seller_id, coalesce(bool_or(d < 0), false) AS sold
      FROM steps GROUP BY ALL)
    SELECT category, count(*) AS sellers_count,
      count(*) FILTER (WHERE sold) AS sellers_with_sales_count,
      count(*) FILTER (WHERE sold) / count(*) * 100 AS pct_sellers_with_sales
    FROM s GROUP BY category""",
)
def agg_seller_coverage(t: Tables):
    flagged = any_by(_sold(t), ["category", "seller_id"], F.col("sold"), "sold")
    names = ("sellers_count", "sellers_with_sales_count", "pct_sellers_with_sales")
    return coverage(flagged, ["category"], "sold", *names)


@query(
    "agg_stock_all",
    f"""WITH {_FLOW_SQL} SELECT category, CAST(sum(q) AS DOUBLE) AS total_stock
    FROM steps GROUP BY ALL""",
)
def agg_stock_all(t: Tables):
    return _flow(t).select("category", F.col("stock").alias("total_stock"))


@query(
    "agg_stock_current_day",
    f"""WITH {_FLOW_SQL} SELECT category, CAST(sum(q) AS DOUBLE) AS total_stock FROM steps
    WHERE CAST(created AS DATE) = DATE '2000-06-30' GROUP BY ALL""",
)
def agg_stock_current_day(t: Tables):
    rows = (
        t.listings.select("url", breadcrumb_path(F.col("breadcrumbs")).alias("category"))
        .where(F.col("category") != "")
        .join(
            t.observations.where(on_day(F.col("created"), AS_OF)).select(
                "url_id", to_number(F.col("available_quantity")).alias("quantity")
            ),
            F.col("url") == F.col("url_id"),
        )
        .where(F.col("quantity").isNotNull())
    )
    return rows.groupBy("category").agg(exact_sum(F.col("quantity")).alias("total_stock"))


@query(
    "agg_products_in_stock",
    f"""WITH {_FLOW_SQL} SELECT category,
      count(DISTINCT CASE WHEN q > 0 THEN url END) AS products_with_available_quantity,
      count(*) FILTER (WHERE q > 0) AS observations_in_stock
    FROM steps GROUP BY ALL""",
)
def agg_products_in_stock(t: Tables):
    return _flow(t).select("category", "products_with_available_quantity", "observations_in_stock")


@query(
    "agg_revenue_mid",
    f"""WITH {_FLOW_SQL} SELECT category,
      round(CAST(greatest(coalesce(sum((pp + p) * -d), 0), 0) AS DOUBLE) / 2, 4) AS revenue
    FROM steps GROUP BY ALL""",
)
def agg_revenue_mid(t: Tables):
    return rounded(_flow(t).select("category", "revenue"), "revenue")


@query(
    "agg_revenue_sum",
    f"""WITH {_FLOW_SQL} SELECT category, round(CAST(coalesce(sum(p), 0) AS DOUBLE), 4) AS revenue
    FROM steps GROUP BY ALL""",
)
def agg_revenue_sum(t: Tables):
    return rounded(_flow(t).select("category", F.col("price_sum").alias("revenue")), "revenue")


@query(
    "agg_units_sold",
    f"""WITH {_FLOW_SQL} SELECT category,
      CAST(abs(sum(least(0, coalesce(d, 0)))) AS DOUBLE) AS units_sold FROM steps GROUP BY ALL""",
)
def agg_units_sold(t: Tables):
    return _flow(t).select("category", "units_sold")


_CLICK_STEPS_SQL = """steps AS (SELECT url_id, category, created, q,
    q - lag(q) OVER (PARTITION BY url_id ORDER BY created) AS d FROM clicks)"""


def _click_steps(t: Tables):
    rows = t.clicks.select(
        "url_id", "category", "created", to_number(F.col("available_quantity")).alias("quantity")
    )
    history = with_previous(rows, ["url_id"], "created", [], {"before": "quantity"})
    return history.withColumn("stock_change", change(F.col("quantity"), F.col("before")))


@query(
    "agg_size",
    f"""WITH {_CLICK_STEPS_SQL} SELECT category, coalesce(d < 0, false) AS sale_detected,
      count(*) AS total_sales FROM steps GROUP BY ALL""",
)
def agg_size(t: Tables):
    flagged = _click_steps(t).withColumn("sale_detected", is_sale(F.col("stock_change")))
    return flagged.groupBy("category", "sale_detected").agg(
        F.count(F.lit(1)).alias("total_sales")
    )


@query(
    "agg_changed_products",
    f"""WITH {_CLICK_STEPS_SQL} SELECT category,
      count(DISTINCT CASE WHEN d <> 0 THEN url_id END) AS changed_products FROM steps GROUP BY ALL""",
)
def agg_changed_products(t: Tables):
    moved = is_movement(F.col("stock_change"), first_counts=False)
    return count_distinct_by(_click_steps(t), ["category"], "url_id", "changed_products", moved)


@query("agg_max_ts", "SELECT max(created) AS latest FROM observations")
def agg_max_ts(t: Tables):
    return t.observations.agg(F.max("created").alias("latest"))
