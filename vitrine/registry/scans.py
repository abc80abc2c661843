"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.dates import day_text
from vitrine.functions.names import breadcrumb_names
from vitrine.registry.book import bigint, query
from vitrine.registry.tables import Tables
from vitrine.session import work_dir
from vitrine.sinks.writers import write_by_day, write_csv, write_table
from vitrine.sources.readers import (
    name_by_position,
    read_csv,
    read_csv_with_lists,
    read_table,
    scan,
)
from vitrine.streaming.sweep import append_new_days


@query(
    "src_table_scan",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
)
def src_table_scan(t: Tables):
    return t.table("lineitem")


@query(
    "src_positional_names",
    """SELECT url_id AS url, available_quantity, price, created AS product_created
    FROM observations""",
)
def src_positional_names(t: Tables):
    rows = t.observations.select("url_id", "available_quantity", "price", "created")
    return name_by_position(rows, ["url", "available_quantity", "price", "product_created"])


@query("src_pruned_scan", "SELECT url_id, price, created FROM observations")
def src_pruned_scan(t: Tables):
    return scan(t.observations, "url_id", "price", "created")


@query(
    "src_filtered_subquery",
    "SELECT url_id, price, created FROM observations WHERE product_id = 'I7'",
)
def src_filtered_subquery(t: Tables):
    return scan(
        t.observations, "url_id", "price", "created", where=F.col("product_id") == "I7"
    )


@query(
    "src_csv",
    """SELECT url_id, available_quantity, NULLIF(price, '') AS price, created FROM observations""",
)
def src_csv(t: Tables):
    path = work_dir(t.spark)
    rows = t.observations.select(
        "url_id", "available_quantity", F.nullif("price", F.lit("")).alias("price"), "created"
    )
    write_csv(rows, path)
    return read_csv(t.spark, path, rows.schema)


@query(
    "src_csv_list_cell",
    """SELECT url, array_to_string(names, '|') AS names, coalesce(len(names), -1) AS n FROM listings""",
)
def src_csv_list_cell(t: Tables):
    return _csv_listings(t).select(
        "url",
        F.array_join("breadcrumbs", "|").alias("names"),
        F.coalesce(bigint(F.size("breadcrumbs")), F.lit(-1)).alias("n"),
    )


def _csv_listings(t: Tables):
    """Listings as exported to CSV, the breadcrumbs as a Python literal."""
    quoted = F.transform(
        breadcrumb_names(F.col("breadcrumbs")),
        lambda name: F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("\\'")), F.lit("'")),
    )
    path = work_dir(t.spark)
    write_csv(
        t.listings.select(
            "url",
            F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("breadcrumbs"),
        ),
        path,
    )
    schema = T.StructType(
        [T.StructField("url", T.StringType()), T.StructField("breadcrumbs", T.StringType())]
    )
    return read_csv_with_lists(t.spark, path, schema, ["breadcrumbs"])


def csv_listings_and_observations(t: Tables):
    """Both CSV files of the changed-products report. A cell that is no number is read as NULL."""
    path = work_dir(t.spark)
    rows = t.observations.select(
        "url_id", "created", "available_quantity", "l_orderkey", "l_linenumber"
    )
    write_csv(rows, path)
    schema = T.StructType(
        [
            T.StructField("url_id", T.StringType()),
            T.StructField("created", T.TimestampNTZType()),
            T.StructField("available_quantity", T.DoubleType()),
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_linenumber", T.IntegerType()),
        ]
    )
    return _csv_listings(t), read_csv(t.spark, path, schema)


@query("sink_csv_roundtrip", "SELECT url, breadcrumbs, brand, seller_id, created FROM listings")
def sink_csv_roundtrip(t: Tables):
    path = work_dir(t.spark)
    rows = t.listings.select("url", "breadcrumbs", "brand", "seller_id", "created")
    write_csv(rows, path)
    return read_csv(t.spark, path, rows.schema)


@query(
    "sink_parquet_roundtrip",
    "SELECT url_id, available_quantity, price, created, l_orderkey, l_linenumber FROM observations",
)
def sink_parquet_roundtrip(t: Tables):
    path = work_dir(t.spark)
    write_table(t.observations.drop("product_id"), path)
    return read_table(t.spark, path)


@query(
    "sink_partitioned",
    """SELECT url_id, price, created, CAST(CAST(created AS DATE) AS VARCHAR) AS snapshot_date
    FROM clicks""",
)
def sink_partitioned(t: Tables):
    path = work_dir(t.spark)
    days = t.clicks.withColumn("snapshot_date", F.to_date("created"))
    write_by_day(days.select("url_id", "price", "created", "snapshot_date"), path, "snapshot_date")
    return read_table(t.spark, path).withColumn("snapshot_date", day_text(F.col("snapshot_date")))


@query(
    "sink_streamed_days",
    """SELECT event_id, user_id, event_type, value, ts, props,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot_date FROM events""",
)
def sink_streamed_days(t: Tables):
    path = work_dir(t.spark)
    schema = t.table("events").schema
    append_new_days(
        t.spark,
        t.folder,
        schema,
        f"{path}/days",
        f"{path}/checkpoint",
        time="ts",
        files="events.parquet",
    ).awaitTermination()
    return read_table(t.spark, f"{path}/days").withColumn(
        "snapshot_date", day_text(F.col("snapshot_date"))
    )
