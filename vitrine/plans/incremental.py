"""The stock-flow report kept up to date day by day.

A day of a listing is summed up in one row: its first and last observation, and what happened in
between. Such rows can be put together: where two days of a listing meet, the step from the last
observation of the one to the first of the other is added. So a report over any look-back needs
the rows of its days only, and a new day adds its own rows and touches no other.

``DayStore`` keeps these rows and the observations they come from below one folder. A load writes a
new generation of the periods (days or months) it touches, and counts when its manifest is there: a load
that breaks off leaves nothing behind that is read. Observations that are in already, as in a file delivered again,
are left out; late ones go to their day, of which only their listings are summed up anew.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.numbers import exact_sum
from vitrine.operators.measures import stock_flow_by
from vitrine.operators.panel import change, is_movement, is_sale, step_revenue_doubled, with_previous
from vitrine.operators.skew import DEFAULT_POLICY, SkewPolicy
from vitrine.plans.config import Scope
from vitrine.plans.histories import FINAL_RULES, FlowRules
from vitrine.plans.inputs import clean_facts, target_listings

_COUNTS = ("movements", "sales")
_SUMS = ("revenue_doubled", "units")


def _steps(now: Column, price: Column, before: Column, price_before: Column) -> dict[str, Column]:
    """What one step adds, a first one (without a row before it) counted apart."""
    moved = change(now, before)
    return {
        "movements": is_movement(moved, first_counts=False).cast("long"),
        "sales": is_sale(moved).cast("long"),
        "revenue_doubled": step_revenue_doubled(price_before, price, moved),
        "units": F.least(moved, F.lit(0.0)),
    }


def day_rows(
    facts: DataFrame, tiebreak: Sequence[str], policy: SkewPolicy = DEFAULT_POLICY
) -> DataFrame:
    """One row for each listing and day of cleaned observations (see plans.inputs.clean_facts).

    A listing with very many observations in a day is cut into slices, as in the batch report.
    """
    rows = facts.where(F.col("url_id").isNotNull()).withColumn("day", F.to_date("created"))
    stepped = with_previous(
        rows,
        ["url_id", "day"],
        "created",
        tiebreak,
        {"_q": "quantity", "_p": "price", "_there": "day"},
        policy=policy,
        null_keys=False,
    )
    place = F.struct("created", *tiebreak)
    seen = F.struct("quantity", "price")
    inside = _steps(F.col("quantity"), F.col("price"), F.col("_q"), F.col("_p"))
    # A first row of the day has no row before it here; its step is found when days are put together.
    inside = {name: F.when(F.col("_there").isNotNull(), step) for name, step in inside.items()}
    # A quantity that is unknown makes an unknown step, which the rules may count as a movement.
    unknown = F.col("_there").isNotNull() & (F.col("quantity").isNull() | F.col("_q").isNull())
    return stepped.groupBy("url_id", "day").agg(
        F.min_by(seen, place).alias("first"),
        F.max_by(seen, place).alias("last"),
        F.count(F.lit(1)).alias("observations"),
        F.count_if(unknown).alias("unknown"),
        *[F.coalesce(F.sum(inside[name]), F.lit(0)).alias(name) for name in _COUNTS],
        *[exact_sum(inside[name]).alias(name) for name in _SUMS],
        F.count_if(F.col("quantity") > 0).alias("stocked"),
        exact_sum(F.col("quantity")).alias("stock"),
        exact_sum(F.col("price")).alias("price_sum"),
    )


def totals_of_days(days: DataFrame, rules: FlowRules = FINAL_RULES, today: date | None = None) -> DataFrame:
    """One row per listing, as plans.histories.listing_totals has them, from rows of its days.

    A group here is the days of one listing.
    """
    before = F.lag("last").over(Window.partitionBy("url_id").orderBy("day"))
    joined = days.withColumn("_before", before)
    first, last = F.col("first"), F.col("_before")
    across = _steps(first["quantity"], first["price"], last["quantity"], last["price"])
    begins = last.isNull() | first["quantity"].isNull() | last["quantity"].isNull()
    joined = joined.withColumns(
        {f"_{name}": F.when(last.isNotNull(), step) for name, step in across.items()}
    ).withColumn("_unknown", F.col("unknown") + begins.cast("long"))
    is_today = F.lit(False) if today is None else F.col("day") == F.lit(today)

    def both(name: str) -> Column:
        inner, outer = exact_sum(F.col(name)), exact_sum(F.col(f"_{name}"))
        return F.when(inner.isNull(), outer).otherwise(inner + F.coalesce(outer, F.lit(0.0)))

    movements = F.sum(F.col("movements") + F.coalesce("_movements", F.lit(0)))
    if rules.first_counts:
        movements = movements + F.sum("_unknown")
    return joined.groupBy(F.col("url_id").alias("url")).agg(
        movements.alias("movements"),
        F.sum(F.col("sales") + F.coalesce("_sales", F.lit(0))).alias("sales"),
        F.sum("stocked").alias("stocked"),
        exact_sum(F.col("stock")).alias("stock"),
        exact_sum(F.when(is_today, F.col("stock"))).alias("stock_today"),
        both("revenue_doubled").alias("revenue_doubled"),
        exact_sum(F.col("price_sum")).alias("price_sum"),
        both("units").alias("units"),
    )


@dataclass(frozen=True)
class Manifest:
    """The loads that hold the observations of each period, and the one that holds its day rows."""

    number: int = 0
    parts: dict[str, list[int]] = field(default_factory=dict)
    sums: dict[str, int] = field(default_factory=dict)

    def observations(self, base: str, periods: set[str] | None = None) -> list[str]:
        return [
            f"{base}/observations/load={n}/period={period}"
            for period, loads in sorted(self.parts.items())
            if periods is None or period in periods
            for n in loads
        ]

    def days(self, base: str, periods: set[str] | None = None, first: str = "") -> list[str]:
        return [
            f"{base}/days/load={n}/period={period}"
            for period, n in sorted(self.sums.items())
            if period >= first and (periods is None or period in periods)
        ]


@dataclass(frozen=True)
class DayStore:
    """Observations and their day rows below one folder. One writer at a time.

    schema: columns of the observations, as DDL.
    tiebreak: with ``created`` it tells a listing's observations apart; a row with the same is the
        same observation, delivered again.
    period: what one folder holds, "day", or "month" for small tables.
    """

    spark: SparkSession
    path: str
    schema: str
    tiebreak: tuple[str, ...]
    period: str = "day"
    rules: FlowRules = FINAL_RULES
    policy: SkewPolicy = DEFAULT_POLICY

    @property
    def _names(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).names

    def _period(self, time: str = "created") -> Column:
        return F.date_trunc(self.period, time).cast("date")

    def manifest(self) -> Manifest:
        """The newest load that was completed. Holds a line for each period."""
        try:
            found = self.spark.read.text(f"{self.path}/manifest/*")
        except AnalysisException:
            return Manifest()
        newest = found.orderBy(F.get_json_object("value", "$.number").cast("long").desc()).first()
        return Manifest() if newest is None else Manifest(**json.loads(newest[0]))

    def load(self, rows: DataFrame) -> int:
        """Take observations in; gives the number of periods touched.

        Rows without a listing or a time are left out, and those that are in already.
        """
        now = self.manifest()
        number = now.number + 1
        key = ["url_id", "created", *self.tiebreak]
        batch = rows.where(F.col("url_id").isNotNull() & F.col("created").isNotNull())
        paths = now.observations(self.path, _days(batch.select(self._period())))
        batch = batch.select(*self._names).dropDuplicates(key)
        known = self._observations(paths)
        if paths:
            there = known.select(*[F.col(name).alias(f"_{name}") for name in key])
            same = F.col("url_id") == F.col("_url_id")
            for name in key[1:]:
                same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
            batch = batch.join(there, same, "left_anti")
        part = f"{self.path}/observations/load={number}"
        # By period, so there are as many files as periods and sizes ask for, not one for each task and period.
        batch = batch.withColumn("period", self._period()).hint("rebalance", "period")
        batch.write.mode("overwrite").partitionBy("period").parquet(part)
        periods = self._written(part)
        if not periods:
            return 0
        fresh = self.spark.read.schema(self.schema).parquet(part).select(*self._names)
        # Of the days touched, the listings with new observations are summed up anew.
        history, old = fresh, self._days(now.days(self.path, periods))
        if paths:
            touched = fresh.select("url_id", F.to_date("created").alias("day")).distinct()
            days = known.withColumn("day", F.to_date("created"))
            history = fresh.unionByName(days.join(touched, ["url_id", "day"], "left_semi").drop("day"))
        scope = Scope(as_of=None, targets=None, tiebreak=self.tiebreak)
        facts = clean_facts(history, scope, self.rules.fill, self.rules.strict_quantity)
        made = day_rows(facts, self.tiebreak, self.policy)
        if old is not None:
            made = made.unionByName(old.join(touched, ["url_id", "day"], "left_anti"))
        target = f"{self.path}/days/load={number}"
        made = made.withColumn("period", self._period("day"))
        made.hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(target)
        summed = self._written(target)
        parts, sums = dict(now.parts), dict(now.sums)
        for period in periods:
            parts[period] = [*parts.get(period, []), number]
            sums.pop(period, None)
            if period in summed:
                sums[period] = number
        told = json.dumps({"number": number, "parts": parts, "sums": sums})
        line = self.spark.createDataFrame([(told,)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.path}/manifest/{number:012d}")
        return len(periods)

    def _observations(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _days(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    def _written(self, path: str) -> set[str]:
        """The periods of a load, from its folders."""
        return _days(self.spark.read.schema("period date").parquet(path).select("period"))

    def observations(self) -> DataFrame:
        """All observations taken in, each once."""
        return self._observations(self.manifest().observations(self.path))

    def days(self, since: date | None = None) -> DataFrame:
        """The rows of the days from a date on."""
        first = ""
        if since is not None:
            first = (since.replace(day=1) if self.period == "month" else since).isoformat()
        found = self._days(self.manifest().days(self.path, first=first))
        if found is None:
            scope = Scope(as_of=None, targets=None, tiebreak=self.tiebreak)
            return day_rows(clean_facts(self._observations([]), scope), self.tiebreak, _OFF)
        return found if since is None else found.where(F.col("day") >= F.lit(since))

    def report(self, listings: DataFrame, scope: Scope) -> DataFrame:
        """What stock_flow_report gives over the same observations.

        Reads one row for each listing and day of the look-back, and no observation.
        """
        since = None
        if scope.as_of is not None:
            since = scope.as_of - timedelta(days=scope.lookback_days)
        totals = totals_of_days(self.days(since), self.rules, scope.as_of)
        wanted = target_listings(listings, scope).join(totals, "url")
        return stock_flow_by(wanted, ["category"], self.rules.unit).select(
            "category",
            "total_products",
            "products_with_movement",
            "products_with_sales",
            "pct_with_movement",
            "pct_with_sales",
            "products_with_available_quantity",
            "revenue",
            F.col("stock_today").alias("total_stock"),
        )


_OFF = SkewPolicy(enabled=False)


def _days(periods: DataFrame) -> set[str]:
    """The different dates of a column, which are as many as the periods of a load."""
    return {str(row[0]) for row in periods.distinct().collect()}
