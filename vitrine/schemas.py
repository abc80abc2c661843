"""Column layout of the three catalogue tables."""

from __future__ import annotations

from pyspark.sql import types as T

LISTINGS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("breadcrumbs", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("seller_id", T.LongType()),
        T.StructField("created", T.TimestampNTZType()),
    ]
)

OBSERVATIONS = T.StructType(
    [
        T.StructField("url_id", T.StringType()),
        T.StructField("available_quantity", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
    ]
)

SELLERS = T.StructType(
    [
        T.StructField("seller_id", T.LongType()),
        T.StructField("seller_name", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
    ]
)
