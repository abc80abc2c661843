"""The given parquet tables seen as the three catalogue tables.

The rules put dirt into the data: prices and quantities that are no numbers, broken and
empty JSON, brands as list and as object, sellers with two snapshots.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.readers import read_table


# Given types, so that opening a table starts no job to find them out.
SCHEMAS = {
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", SCHEMAS.get(name))

    @cached_property
    def listings(self) -> DataFrame:
        part = self.table("part")
        sellers = self.table("supplier").agg(F.count(F.lit(1))).scalar()
        return part.select(
            F.expr("'P' || p_partkey").alias("url"),
            F.expr("'I' || p_partkey").alias("product_id"),
            F.expr(
                """case p_partkey % 20 when 0 then null when 1 then 'not json' when 2 then '[]'
                else '[{"name":"' || p_type || '"},null,{"name":"' || p_name || '"}]' end"""
            ).alias("breadcrumbs"),
            F.expr(
                """case p_partkey % 10 when 0 then '{"name":"' || p_brand || '"}'
                when 1 then '[]' when 2 then 'bad' when 3 then null
                when 4 then '[{"name":"' || p_brand || '"},{"name":"Brand#1"}]'
                else '[{"name":"' || p_brand || '"}]' end"""
            ).alias("brand"),
            (F.col("p_partkey") % sellers).alias("seller_id"),
            F.expr("cast(date'1995-01-01' + cast(p_partkey % 365 as int) as timestamp_ntz)").alias(
                "created"
            ),
        )

    @cached_property
    def observations(self) -> DataFrame:
        return self.as_observations(self.table("lineitem"))

    @staticmethod
    def as_observations(lines: DataFrame) -> DataFrame:
        return lines.select(
            F.expr("'P' || l_partkey").alias("url_id"),
            F.expr("'I' || l_partkey").alias("product_id"),
            F.expr(
                """case when (l_orderkey + l_linenumber) % 97 = 0 then 'n/a'
                else cast(cast(l_quantity as int) as string) end"""
            ).alias("available_quantity"),
            F.expr(
                """case when l_orderkey % 89 = 0 then ''
                else cast(cast(l_extendedprice as decimal(18,2)) as string) end"""
            ).alias("price"),
            F.col("l_shipdate").alias("created"),
            "l_orderkey",
            "l_linenumber",
        )

    @cached_property
    def sellers(self) -> DataFrame:
        supplier = self.table("supplier")
        first = supplier.select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("seller_name"),
            F.expr("timestamp_ntz'1999-01-01'").alias("created"),
        )
        renamed = supplier.where("s_acctbal < 5000").select(
            F.col("s_suppkey").alias("seller_id"),
            F.expr("s_name || ' (new)'").alias("seller_name"),
            F.expr("timestamp_ntz'2000-01-01'").alias("created"),
        )
        return first.unionByName(renamed)

    @cached_property
    def clicks(self) -> DataFrame:
        """A second panel with full timestamps: a user's events as a listing's observations."""
        return self.table("events").select(
            F.expr("'U' || user_id").alias("url_id"),
            F.get_json_object("props", "$.k").alias("available_quantity"),
            F.col("value").alias("price"),
            F.col("ts").alias("created"),
            F.col("event_type").alias("category"),
        )


# The same rules as SQL, with the results of JSON parsing stated directly by rule.
LISTINGS_SQL = """listings AS (
  SELECT 'P' || p_partkey AS url, 'I' || p_partkey AS product_id,
    CASE p_partkey % 20 WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN '[]'
      ELSE '[{"name":"' || p_type || '"},null,{"name":"' || p_name || '"}]' END AS breadcrumbs,
    CASE p_partkey % 10 WHEN 0 THEN '{"name":"' || p_brand || '"}' WHEN 1 THEN '[]'
      WHEN 2 THEN 'bad' WHEN 3 THEN NULL
      WHEN 4 THEN '[{"name":"' || p_brand || '"},{"name":"Brand#1"}]'
      ELSE '[{"name":"' || p_brand || '"}]' END AS brand,
    p_partkey % (SELECT count(*) FROM supplier) AS seller_id,
    CAST(DATE '1995-01-01' + CAST(p_partkey % 365 AS INTEGER) AS TIMESTAMP) AS created,
    CASE WHEN p_partkey % 20 IN (0, 1) THEN NULL WHEN p_partkey % 20 = 2 THEN ''
      ELSE p_type || ',' || p_name END AS path_cased,
    CASE WHEN p_partkey % 20 IN (0, 1) THEN NULL WHEN p_partkey % 20 = 2 THEN ''
      ELSE lower(p_type) || ',' || lower(p_name) END AS path,
    CASE WHEN p_partkey % 20 IN (0, 1, 2) THEN NULL ELSE p_name END AS last_name,
    CASE WHEN p_partkey % 20 IN (0, 1) THEN NULL WHEN p_partkey % 20 = 2 THEN []
      ELSE [p_type, p_name] END AS names,
    CASE WHEN p_partkey % 10 IN (2, 3) THEN NULL WHEN p_partkey % 10 = 1 THEN []
      WHEN p_partkey % 10 = 4 THEN [p_brand, 'Brand#1'] ELSE [p_brand] END AS brands
  FROM part)"""

OBSERVATIONS_SQL = """observations AS (
  SELECT 'P' || l_partkey AS url_id, 'I' || l_partkey AS product_id,
    CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 'n/a'
      ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS available_quantity,
    CASE WHEN l_orderkey % 89 = 0 THEN ''
      ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
    l_shipdate AS created, l_orderkey, l_linenumber,
    CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN NULL
      ELSE CAST(l_quantity AS INTEGER) END AS q,
    CASE WHEN l_orderkey % 89 = 0 THEN NULL
      ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS p
  FROM lineitem)"""

SELLERS_SQL = """sellers AS (
  SELECT s_suppkey AS seller_id, s_name AS seller_name, TIMESTAMP '1999-01-01' AS created
  FROM supplier
  UNION ALL
  SELECT s_suppkey, s_name || ' (new)', TIMESTAMP '2000-01-01' FROM supplier WHERE s_acctbal < 5000)"""

CLICKS_SQL = """clicks AS (
  SELECT 'U' || user_id AS url_id, json_extract_string(props, '$.k') AS available_quantity,
    value AS price, ts AS created, event_type AS category,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS q
  FROM events)"""

TABLES_SQL = {
    "listings": LISTINGS_SQL,
    "observations": OBSERVATIONS_SQL,
    "sellers": SELLERS_SQL,
    "clicks": CLICKS_SQL,
}
