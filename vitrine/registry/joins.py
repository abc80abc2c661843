"""Joins and row generators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vitrine.functions.names import brand_names, breadcrumb_names, breadcrumb_path
from vitrine.operators.expand import per_element
from vitrine.operators.filters import between
from vitrine.operators.joins import (
    assemble,
    latest_per_key,
    listings_with_facts,
    listings_with_recent_facts,
    with_dimension,
)
from vitrine.registry.book import query
from vitrine.registry.params import AS_OF, DAYS, SLICED, TIE
from vitrine.registry.tables import Tables


def _facts(t: Tables):
    return t.observations.select("url_id", "available_quantity", "price", "created", *TIE)


@query(
    "join_left_on_bound",
    """SELECT l.url, l.seller_id, o.available_quantity, o.price, o.created, o.l_orderkey,
      o.l_linenumber
    FROM listings l
    LEFT JOIN observations o ON l.url = o.url_id AND o.created >= TIMESTAMP '1999-07-01'""",
)
def join_left_on_bound(t: Tables):
    listings = t.listings.select("url", "seller_id")
    return listings_with_recent_facts(listings, _facts(t), AS_OF, DAYS).drop("url_id")


@query(
    "join_left",
    """SELECT l.url, l.product_id, c.price, c.created
    FROM listings l LEFT JOIN clicks c ON l.url = replace(c.url_id, 'U', 'P')""",
)
def join_left(t: Tables):
    clicks = t.clicks.select(
        F.replace("url_id", F.lit("U"), F.lit("P")).alias("url_id"), "price", "created"
    )
    return listings_with_facts(t.listings.select("url", "product_id"), clicks).drop("url_id")


@query(
    "join_left_sliced",
    """SELECT l.url, l.product_id, o.price, o.created, o.l_orderkey, o.l_linenumber
    FROM listings l LEFT JOIN observations o ON l.url = o.url_id""",
)
def join_left_sliced(t: Tables):
    """A left join with every listing cut into slices, as hot ones are."""
    facts = _facts(t).drop("available_quantity")
    listings = t.listings.select("url", "product_id")
    return listings_with_facts(listings, facts, policy=SLICED).drop("url_id")


@query(
    "join_inner",
    """SELECT l.product_id, l.path AS category, o.price, o.l_orderkey, o.l_linenumber, o.created
    FROM observations o JOIN listings l ON o.url_id = l.url
    WHERE o.created >= TIMESTAMP '2000-01-15' AND o.created <= TIMESTAMP '2000-02-15'""",
)
def join_inner(t: Tables):
    facts = _facts(t).where(between(F.col("created"), date(2000, 1, 15), date(2000, 2, 15)))
    listings = t.listings.select(
        "url", "product_id", breadcrumb_path(F.col("breadcrumbs")).alias("category")
    )
    return listings_with_facts(listings, facts, "inner").drop("url", "url_id", "available_quantity")


@query(
    "join_three_way",
    """SELECT l.url, l.seller_id, s.seller_name, s.created AS seller_created,
      o.available_quantity, o.price, o.created AS product_created, o.l_orderkey, o.l_linenumber
    FROM listings l
    JOIN (SELECT seller_id, seller_name, created,
        row_number() OVER (PARTITION BY seller_id ORDER BY created DESC) AS rn FROM sellers) s
      ON l.seller_id = s.seller_id AND s.rn = 1
    LEFT JOIN observations o ON l.url = o.url_id AND o.created >= TIMESTAMP '1999-07-01'""",
)
def join_three_way(t: Tables):
    sellers = latest_per_key(t.sellers, "seller_id", "created").withColumnRenamed(
        "created", "seller_created"
    )
    listings = with_dimension(t.listings.select("url", "seller_id"), sellers, "seller_id", "inner")
    return (
        listings_with_recent_facts(listings, _facts(t), AS_OF, DAYS)
        .drop("url_id")
        .withColumnRenamed("created", "product_created")
    )


@query(
    "join_filtered_inputs",
    """SELECT l.url, o.price, o.created, o.l_orderkey, o.l_linenumber
    FROM (SELECT * FROM listings WHERE product_id = 'I42') l
    LEFT JOIN (SELECT * FROM observations WHERE created >= TIMESTAMP '1996-01-15'
      AND created <= TIMESTAMP '2000-02-15' AND product_id = 'I42') o ON l.url = o.url_id""",
)
def join_filtered_inputs(t: Tables):
    one = F.col("product_id") == "I42"
    facts = t.observations.where(
        one & between(F.col("created"), date(1996, 1, 15), date(2000, 2, 15))
    ).select("url_id", "price", "created", *TIE)
    return listings_with_facts(t.listings.where(one).select("url"), facts).drop("url_id")


@query(
    "join_using",
    """SELECT url, l.seller_id, o.price, o.l_orderkey, o.l_linenumber, o.created
    FROM listings l JOIN (SELECT url_id AS url, price, l_orderkey, l_linenumber, created
      FROM observations) o USING (url)""",
)
def join_using(t: Tables):
    facts = t.observations.select(F.col("url_id").alias("url"), "price", *TIE, "created")
    return t.listings.select("url", "seller_id").join(facts, "url")


@query(
    "join_left_on_right_on",
    """SELECT l.product_id, l.url, o.url_id, o.price, o.l_orderkey, o.l_linenumber, o.created
    FROM listings l JOIN observations o ON l.url = o.url_id
    WHERE o.created >= TIMESTAMP '2000-01-15' AND o.created <= TIMESTAMP '2000-02-15'""",
)
def join_left_on_right_on(t: Tables):
    facts = t.observations.where(
        between(F.col("created"), date(2000, 1, 15), date(2000, 2, 15))
    ).select("url_id", "price", *TIE, "created")
    return listings_with_facts(t.listings.select("product_id", "url"), facts, "inner")


@query(
    "join_full_outer",
    """SELECT coalesce(l.url, c.url_id) AS url, l.path, c.price, c.created
    FROM listings l
    FULL OUTER JOIN (SELECT 'P' || user_id * 20 AS url_id, value AS price, ts AS created
      FROM events) c ON l.url = c.url_id""",
)
def join_full_outer(t: Tables):
    """Most listings have no click, and many clicks have no listing."""
    listings = t.listings.select("url", breadcrumb_path(F.col("breadcrumbs")).alias("path"))
    clicks = t.table("events").select(
        F.expr("'P' || user_id * 20").alias("url_id"),
        F.col("value").alias("price"),
        F.col("ts").alias("created"),
    )
    joined = listings_with_facts(listings, clicks, "full_outer")
    return joined.withColumn("url", F.coalesce("url", "url_id")).drop("url_id")


@query(
    "join_left_dim",
    """SELECT l.url, l.seller_id, s.seller_name FROM listings l
    LEFT JOIN (SELECT seller_id, seller_name,
        row_number() OVER (PARTITION BY seller_id ORDER BY created DESC) AS rn FROM sellers) s
      ON l.seller_id = s.seller_id AND s.rn = 1""",
)
def join_left_dim(t: Tables):
    sellers = latest_per_key(t.sellers, "seller_id", "created").drop("created")
    return with_dimension(t.listings.select("url", "seller_id"), sellers, "seller_id")


_PER_CATEGORY_SQL = """categories AS (
  SELECT category, count(DISTINCT url_id) AS users, count(*) AS n FROM clicks GROUP BY category),
busy AS (SELECT category, count(*) AS dear FROM clicks WHERE price > 100 GROUP BY category)"""


def _per_category(t: Tables):
    users = t.clicks.groupBy("category", "url_id").agg(F.count(F.lit(1)).alias("n"))
    whole = users.groupBy("category").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("n")
    )
    dear = (
        t.clicks.where(F.col("price") > 100)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("dear"))
    )
    return whole, dear


@query(
    "join_assemble_left",
    f"""WITH {_PER_CATEGORY_SQL}
    SELECT category, users, n, coalesce(dear, 0) AS dear
    FROM categories LEFT JOIN busy USING (category)""",
)
def join_assemble_left(t: Tables):
    return assemble(_per_category(t), "category", "left").na.fill(0, ["dear"])


@query(
    "join_assemble_inner",
    f"""WITH {_PER_CATEGORY_SQL}
    SELECT category, users, n, dear FROM categories JOIN busy USING (category)""",
)
def join_assemble_inner(t: Tables):
    return assemble(_per_category(t), "category", "inner")


@query(
    "gen_explode_categories",
    """SELECT url, unnest(CASE WHEN names IS NULL OR len(names) = 0 THEN [NULL] ELSE names END)
      AS category FROM listings""",
)
def gen_explode_categories(t: Tables):
    return per_element(
        t.listings.select("url", breadcrumb_names(F.col("breadcrumbs")).alias("category")),
        "category",
    )


@query(
    "gen_explode_brands",
    """SELECT url, category,
      unnest(CASE WHEN brands IS NULL OR len(brands) = 0 THEN [NULL] ELSE brands END) AS brand
    FROM (SELECT url, brands,
      unnest(CASE WHEN names IS NULL OR len(names) = 0 THEN [NULL] ELSE names END) AS category
      FROM listings)""",
)
def gen_explode_brands(t: Tables):
    rows = t.listings.select(
        "url",
        breadcrumb_names(F.col("breadcrumbs")).alias("category"),
        brand_names(F.col("brand")).alias("brand"),
    )
    return per_element(per_element(rows, "category"), "brand")
