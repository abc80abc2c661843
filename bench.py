"""Time the reports and the heavier operators; prints one JSON line.

BENCH_SF_DIR: data folder (default sf0.1). BENCH_CPUS: local cores (default 8).
Each query runs once to warm up and is then timed; results go to the no-op sink, so every
column is computed and nothing passes the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vitrine.operators.skew import SkewPolicy  # noqa: E402
from vitrine.plans.stock_flow import stock_flow_report  # noqa: E402
from vitrine.registry import QUERIES  # noqa: E402
from vitrine.registry.params import EVERYTHING, SCOPE  # noqa: E402
from vitrine.registry.tables import Tables  # noqa: E402
from vitrine.session import local_session  # noqa: E402

HEADLINE = [
    "report_price",
    "report_price_last_category",
    "report_price_product",
    "report_brand_seller",
    "report_brand_raw",
    "report_seller_price",
    "report_stock_flow",
    "report_stock_flow_draft",
    "report_stock_flow_ancestors",
    "report_changed_products",
    "extract_filtered",
    "agg_price_by_path",
    "agg_price_by_product",
    "agg_any_brand_seller",
    "join_left_on_bound",
    "join_full_outer",
    "win_stock_change",
    "win_last_value",
    "map_lookup",
    "sort_multi_key",
    "sink_partitioned",
]


def skewed(spark, folder: str) -> dict[str, float]:
    """The stock-flow report when one listing holds a third of all rows, cut and not cut."""
    t = Tables(spark, folder)
    third = F.when(F.col("l_orderkey") % 3 == 0, F.lit("P3")).otherwise(F.col("url_id"))
    facts = t.observations.withColumn("url_id", third)
    seconds = {}
    for label, policy in (("cut", SkewPolicy(min_rows=20_000)), ("not_cut", SkewPolicy(enabled=False))):
        scope = replace(EVERYTHING, skew=policy, as_of=SCOPE.as_of, lookback_days=10_000)
        for _ in range(2):
            start = time.perf_counter()
            stock_flow_report(t.listings, facts, scope).write.format("noop").mode("overwrite").save()
            seconds[label] = round(time.perf_counter() - start, 3)
    return seconds


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
    hot = skewed(spark, folder) if not sys.argv[1:] else {}
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "skewed_stock_flow": hot,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
