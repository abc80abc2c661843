"""Sinks (K1-K3). Every writer writes from the tasks; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled inside quoted cells."""
    (
        rows.write.mode(mode)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def write_by_day(rows: DataFrame, path: str, day: str, mode: str = "overwrite") -> None:
    """One folder per day.

    Rebalancing gathers small days into few files and splits a large day over several tasks.
    """
    rows.hint("rebalance", day).write.mode(mode).partitionBy(day).parquet(path)
