"""Listing histories: windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.names import brand_names
from vitrine.functions.numbers import midpoint, to_number
from vitrine.operators.expand import per_element
from vitrine.operators.panel import (
    any_per_key,
    change,
    is_movement,
    is_sale,
    last_per_key,
    step_revenue_doubled,
    with_previous,
)
from vitrine.operators.skew import DEFAULT_POLICY, SkewPolicy
from vitrine.registry.book import query, query_like, rounded
from vitrine.registry.params import SLICED, TIE
from vitrine.registry.tables import Tables
from vitrine.session import work_dir
from vitrine.streaming.steps import append_steps, previous_in_stream

_WINDOW = "OVER (PARTITION BY url_id ORDER BY created, l_orderkey, l_linenumber)"
_STEPS_SQL = f"""steps AS (
  SELECT url_id, created, l_orderkey, l_linenumber, CAST(q AS DOUBLE) AS quantity,
    CAST(q - lag(q) {_WINDOW} AS DOUBLE) AS stock_change
  FROM observations WHERE q IS NOT NULL)"""


def steps(t: Tables, policy: SkewPolicy = DEFAULT_POLICY):
    """Readable observations with their stock change. No observation lacks its listing."""
    rows = t.observations.select(
        "url_id",
        "created",
        *TIE,
        to_number(F.col("available_quantity")).alias("quantity"),
        to_number(F.col("price")).alias("price"),
    ).where(F.col("quantity").isNotNull())
    return with_previous(
        rows,
        ["url_id"],
        "created",
        TIE,
        {"quantity_before": "quantity", "price_before": "price"},
        policy=policy,
        null_keys=False,
    ).withColumn("stock_change", change(F.col("quantity"), F.col("quantity_before")))


_ID = ("url_id", "created", *TIE)


@query(
    "win_stock_change",
    f"WITH {_STEPS_SQL} SELECT url_id, created, l_orderkey, l_linenumber, stock_change FROM steps",
)
def win_stock_change(t: Tables):
    return steps(t).select(*_ID, "stock_change")


@query(
    "win_stock_change_sliced",
    f"WITH {_STEPS_SQL} SELECT url_id, created, l_orderkey, l_linenumber, stock_change FROM steps",
)
def win_stock_change_sliced(t: Tables):
    """The same with every listing cut into slices, as hot ones are."""
    return steps(t, SLICED).select(*_ID, "stock_change")


@query(
    "win_stock_change_brand",
    """WITH x AS (
      SELECT o.url_id, unnest(l.brands) AS brand, o.created, o.l_orderkey, o.l_linenumber, o.q
      FROM observations o JOIN listings l ON o.url_id = l.url WHERE o.q IS NOT NULL)
    SELECT url_id, brand, created, l_orderkey, l_linenumber,
      CAST(q - lag(q) OVER (PARTITION BY url_id, brand ORDER BY created, l_orderkey, l_linenumber)
        AS DOUBLE) AS stock_change
    FROM x""",
)
def win_stock_change_brand(t: Tables):
    brands = per_element(
        t.listings.select("url", brand_names(F.col("brand")).alias("brand")), "brand"
    ).where(F.col("brand").isNotNull())
    rows = (
        t.observations.select(
            "url_id", "created", *TIE, to_number(F.col("available_quantity")).alias("quantity")
        )
        .where(F.col("quantity").isNotNull())
        .join(brands, F.col("url_id") == F.col("url"))
        .drop("url")
    )
    history = with_previous(
        rows, ["url_id", "brand"], "created", TIE, {"quantity_before": "quantity"}, null_keys=False
    )
    moved = change(F.col("quantity"), F.col("quantity_before"))
    return history.select("url_id", "brand", "created", *TIE, moved.alias("stock_change"))


@query(
    "win_sale_flag",
    f"""WITH {_STEPS_SQL} SELECT url_id, created, l_orderkey, l_linenumber,
      coalesce(stock_change < 0, false) AS sale_detected FROM steps""",
)
def win_sale_flag(t: Tables):
    return steps(t).select(*_ID, is_sale(F.col("stock_change")).alias("sale_detected"))


@query(
    "win_movement_flag",
    f"""WITH {_STEPS_SQL} SELECT url_id, created, l_orderkey, l_linenumber,
      (stock_change IS NULL OR stock_change <> 0) AS movement_detected,
      (stock_change IS NOT NULL AND stock_change <> 0) AS later_movement FROM steps""",
)
def win_movement_flag(t: Tables):
    moved = F.col("stock_change")
    return steps(t).select(
        *_ID,
        is_movement(moved).alias("movement_detected"),
        is_movement(moved, first_counts=False).alias("later_movement"),
    )


@query(
    "win_midprice_revenue",
    f"""SELECT url_id, created, l_orderkey, l_linenumber,
      CAST((p + pp) * 0.5 AS DOUBLE) AS mid_price,
      CAST((p + pp) * (pq - q) * 0.5 AS DOUBLE) AS step_revenue
    FROM (SELECT url_id, created, l_orderkey, l_linenumber, q, p,
        lag(q) {_WINDOW} AS pq, lag(p) {_WINDOW} AS pp
      FROM observations WHERE q IS NOT NULL)""",
)
def win_midprice_revenue(t: Tables):
    before, price = F.col("price_before"), F.col("price")
    doubled = step_revenue_doubled(before, price, F.col("stock_change"))
    frame = steps(t).select(
        *_ID, midpoint(before, price).alias("mid_price"), (doubled / 2).alias("step_revenue")
    )
    return rounded(frame, "mid_price", "step_revenue")


@query(
    "win_any",
    """SELECT url_id, created, bool_or(d <> 0) OVER (PARTITION BY url_id) AS changed FROM (
      SELECT url_id, created,
        coalesce(q - lag(q) OVER (PARTITION BY url_id ORDER BY created), 0) AS d FROM clicks)""",
)
def win_any(t: Tables):
    rows = t.clicks.select(
        "url_id", "created", to_number(F.col("available_quantity")).alias("quantity")
    )
    history = with_previous(
        rows, ["url_id"], "created", [], {"before": "quantity"}, null_keys=False
    )
    moved = is_movement(change(F.col("quantity"), F.col("before")), first_counts=False)
    flagged = history.withColumn("moved", moved)
    return any_per_key(flagged, "url_id", "moved", "changed").select("url_id", "created", "changed")


@query(
    "win_last_value",
    """SELECT o.url_id, o.created, o.l_orderkey, o.l_linenumber, x.last_price
    FROM observations o JOIN (
      SELECT url_id, arg_max_null(CAST(p AS DOUBLE), (created, l_orderkey, l_linenumber)) AS last_price
      FROM observations GROUP BY url_id) x ON o.url_id = x.url_id""",
)
def win_last_value(t: Tables):
    rows = t.observations.select(
        "url_id", "created", *TIE, to_number(F.col("price")).alias("price")
    )
    return last_per_key(rows, "url_id", "price", "created", TIE, "last_price").drop("price")


@query_like("win_stock_change_streamed", "win_stock_change")
def win_stock_change_streamed(t: Tables):
    """The same from a stream of the file. A last row far in the future lets all others fall due."""
    base = work_dir(t.spark)
    given = t.table("lineitem").schema
    mark = [f"cast({_END.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in given]
    t.spark.range(1).selectExpr(*mark).write.parquet(f"{base}/end")
    # As a pattern, so the table may be one file or a folder of files.
    lines = t.spark.readStream.schema(given).parquet(f"{t.folder}/lineitem.parque[t]")
    end = t.spark.readStream.schema(given).parquet(f"{base}/end")
    rows = t.as_observations(lines.unionByName(end))
    readable = rows.select(
        "url_id", "created", *TIE, to_number(F.col("available_quantity")).alias("quantity")
    ).where(F.col("quantity").isNotNull())
    stepped = previous_in_stream(readable, "url_id", "created", TIE, {"quantity_before": "quantity"})
    append_steps(stepped, f"{base}/steps", f"{base}/checkpoint").awaitTermination()
    moved = change(F.col("quantity"), F.col("quantity_before")).alias("stock_change")
    return t.spark.read.schema(stepped.schema).parquet(f"{base}/steps").select(*_ID, moved)


_END = {"l_partkey": "-1", "l_orderkey": "1", "l_linenumber": "1", "l_quantity": "1", "l_shipdate": "timestamp_ntz'2100-01-01'"}
