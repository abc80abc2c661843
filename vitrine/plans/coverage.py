"""Which brands and sellers sell at all, per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.names import brand_names
from vitrine.functions.numbers import percent
from vitrine.operators.joins import latest_per_key
from vitrine.operators.measures import any_by, coverage
from vitrine.operators.filters import drop_missing
from vitrine.operators.panel import is_sale
from vitrine.operators.skew import SLICE
from vitrine.operators.stats import stats_of_counts
from vitrine.plans.config import Scope
from vitrine.plans.histories import (
    FINAL_RULES,
    ZERO_RULES,
    FlowRules,
    listing_steps,
    listing_totals,
)
from vitrine.plans.inputs import categories_of_listings, target_listings
from vitrine.session import written


def listing_sales(
    wanted: DataFrame, observations: DataFrame, scope: Scope, rules: FlowRules
) -> DataFrame:
    """Per wanted listing with observations: did its stock ever go down, and its latest price."""
    urls = wanted.select("url").distinct()
    return listing_totals(urls, observations, scope, rules).select(
        "url", (F.col("sales") > 0).alias("sold"), F.col("latest.price").alias("last_price")
    )


def brand_seller_report(
    listings: DataFrame, observations: DataFrame, sellers: DataFrame, scope: Scope
) -> DataFrame:
    """Brands and sellers, those with a sale, and percent, per category path.

    A listing has one history, whatever its brands, so sales are found once per listing and
    only then spread over brands. One pass counts brands and sellers together.
    """
    known = latest_per_key(sellers, "seller_id", "created").select("seller_id")
    wanted = target_listings(
        listings,
        scope,
        "path_cased",
        keep=("seller_id", brand_names(F.col("brand")).alias("brands")),
    ).join(known, "seller_id", "inner")
    sales = listing_sales(wanted, observations, scope, FINAL_RULES)
    listed = wanted.join(sales.select("url", "sold"), "url")
    # A seller counts only through a listing that names a brand.
    branded = listed.where(F.size("brands") > 0)
    brand = F.transform(
        "brands",
        lambda name: F.struct(F.lit("brand").alias("kind"), name.alias("member")),
    )
    seller = F.array(
        F.struct(F.lit("seller").alias("kind"), F.col("seller_id").cast("string").alias("member"))
    )
    members = branded.select(
        "category", "sold", F.explode(F.concat(brand, seller)).alias("_m")
    ).select("category", "_m.kind", "_m.member", "sold")
    flagged = any_by(members, ["category", "kind", "member"], F.col("sold"), "sold")
    is_brand = F.col("kind") == "brand"
    return (
        flagged.groupBy("category")
        .agg(
            F.count_if(is_brand & F.col("sold")).alias("brands_with_sales"),
            F.count_if(is_brand).alias("total_brands"),
            F.count_if(~is_brand).alias("sellers_count"),
            F.count_if(~is_brand & F.col("sold")).alias("_sellers"),
        )
        .select(
            F.col("category").alias("categories"),
            "brands_with_sales",
            "total_brands",
            percent(F.col("brands_with_sales"), F.col("total_brands")).alias("pct_brands_with_sales"),
            "sellers_count",
            # No seller with a sale is reported as missing, not as 0.
            F.nullif("_sellers", F.lit(0)).alias("sellers_with_sales_count"),
            percent(F.nullif("_sellers", F.lit(0)), F.col("sellers_count")).alias(
                "pct_sellers_with_sales"
            ),
        )
    )


def raw_brand_report(listings: DataFrame, observations: DataFrame, scope: Scope) -> DataFrame:
    """Brand coverage with the raw brand text as the brand, unsold listings included."""
    wanted = target_listings(listings, scope, "path_cased", keep=("brand",))
    sales = listing_sales(wanted, observations, scope, ZERO_RULES)
    listed = wanted.join(sales.select("url", "sold"), "url", "left")
    flagged = any_by(listed, ["category", "brand"], F.col("sold"), "sold")
    return coverage(
        flagged, ["category"], "sold", "total_brands", "brands_with_sales", "pct_brands_with_sales"
    )


def seller_price_report(listings: DataFrame, observations: DataFrame, scope: Scope) -> DataFrame:
    """Per ancestor category: sellers, sellers with a sale, and prices.

    The lowest price is the lowest latest price of a listing; the other statistics are over
    all observations.
    """
    counts = written(seller_price_counts(listings, observations, scope))
    is_seller = F.col("is_seller") & F.col("seller_id").isNotNull()
    return stats_of_counts(
        counts,
        ["category"],
        "price",
        ("_lowest", "max_price", "avg_price", "median_price"),
        [
            F.min("last_price").alias("min_price"),
            F.count_if(is_seller).alias("total_sellers"),
            F.count_if(is_seller & F.col("sold")).alias("sellers_with_sales"),
        ],
    ).select(
        "category",
        "min_price",
        "total_sellers",
        "sellers_with_sales",
        percent(F.col("sellers_with_sales"), F.col("total_sellers")).alias("pct_sellers_with_sales"),
        "max_price",
        "avg_price",
        "median_price",
    )


def _prices(steps: DataFrame, scope: Scope) -> DataFrame:
    """(url, price, n, sold, last_price, is_last): a row for each observation.

    All of it follows from the order the steps were found in, so rows are sorted once.
    """
    history = Window.partitionBy("url").orderBy("created", *scope.tiebreak)
    whole = history.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return steps.select(
        "url",
        "price",
        F.lit(1).cast("long").alias("n"),
        F.max(is_sale(F.col("stock_change"))).over(whole).alias("sold"),
        F.last("price").over(whole).alias("last_price"),
        F.lead(F.lit(True)).over(history).isNull().alias("is_last"),
    )


def _sliced_prices(steps: DataFrame, scope: Scope) -> DataFrame:
    """The same where no task sees a whole history: a row for each different price of a listing."""

    def merged(rows: DataFrame, keys: list[str], n: Column, sold: Column, at: Column) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.sum(n).alias("n"), F.bool_or(sold).alias("sold"), F.max(at).alias("at")
        )

    keys = ["url", "price"]
    seen = F.struct("created", *scope.tiebreak)
    parts = merged(steps, [*keys, SLICE], F.lit(1), is_sale(F.col("stock_change")), seen)
    per_price = merged(parts, keys, F.col("n"), F.col("sold"), F.col("at"))
    # A bounded group: the different prices of one listing.
    listing = Window.partitionBy("url")
    here = F.struct("at", "price")
    return (
        per_price.withColumn("latest", F.max(here).over(listing))
        .withColumn("sold", F.max("sold").over(listing))
        .select(
            "url",
            "price",
            "n",
            "sold",
            F.col("latest.price").alias("last_price"),
            here.eqNullSafe(F.col("latest")).alias("is_last"),
        )
    )


def seller_price_counts(listings: DataFrame, observations: DataFrame, scope: Scope) -> DataFrame:
    """Rows per (category, price), and per (category, seller) whether it sold anything.

    Facts are read and shuffled once, by listing: the window, the counts of each price and what
    the listing did all follow there. Only then are listings spread over their categories.
    """
    urls = target_listings(listings, scope, "raw").select("url").where(F.col("url").isNotNull())
    steps = listing_steps(urls, observations, scope, ZERO_RULES)
    per_price = _sliced_prices(steps, scope) if SLICE in steps.columns else _prices(steps, scope)
    wanted = categories_of_listings(listings, scope, "seller_id")
    spread = wanted.join(per_price, "url", "left")
    no_seller = F.lit(None).cast(spread.schema["seller_id"].dataType)
    price = F.struct(
        F.lit(False).alias("is_seller"),
        "price",
        (F.coalesce("n", F.lit(0)) * F.col("times")).alias("n"),
        no_seller.alias("seller_id"),
    )
    seller = F.struct(
        F.lit(True).alias("is_seller"),
        F.lit(None).cast("double").alias("price"),
        F.lit(0).cast("long").alias("n"),
        "seller_id",
    )
    both = spread.select(
        "category",
        F.coalesce("sold", F.lit(False)).alias("sold"),
        "last_price",
        # The seller is counted with one price of the listing, or with none.
        F.explode(
            F.when(F.coalesce("is_last", F.lit(True)), F.array(price, seller)).otherwise(F.array(price))
        ).alias("_row"),
    ).select("category", "sold", "last_price", "_row.*")
    return (
        drop_missing(both, "category")
        .groupBy("category", "is_seller", "price", "seller_id")
        .agg(
            F.sum("n").alias("_n"),
            F.bool_or("sold").alias("sold"),
            F.min("last_price").alias("last_price"),
        )
    )
