"""Sources (S1-S6). Connection details always come from the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.names import literal_list


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet table. With a schema, no job has to look into the files first."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def jdbc_options(
    connection: Mapping[str, str],
    query: str | None = None,
    table: str | None = None,
    split_on: str | None = None,
    lower: object = None,
    upper: object = None,
    parts: int | None = None,
    fetch_size: int = 10_000,
    one_task: bool = False,
) -> dict[str, str]:
    """Options of one JDBC read.

    connection: at least ``url``; user, password and driver as the database needs them.
    split_on: a number, date or timestamp column; with lower, upper and parts the read is
        split into that many ranges, each read by its own task. Rows outside the bounds are
        read too, by the first and the last range. For text keys see read_jdbc_parts.
    one_task: read everything through one task, which must be asked for.
    """
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    if "url" not in connection:
        raise ValueError("the connection needs a url")
    options = {**connection, "fetchsize": str(fetch_size)}
    split = (split_on, lower, upper, parts)
    if one_task:
        if any(value is not None for value in split):
            raise ValueError("one_task goes without split_on, lower, upper and parts")
        if query is not None:
            return {**options, "query": query}
        return {**options, "dbtable": table}
    if any(value is None for value in split):
        raise ValueError("give split_on, lower, upper and parts, or say one_task=True")
    return {
        **options,
        "dbtable": _jdbc_source(query, table),
        "partitionColumn": split_on,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
    }


def _jdbc_source(query: str | None, table: str | None) -> str:
    # The reader takes no split together with "query", so the query becomes a derived table.
    return table if query is None else f"({query}) AS source"


def read_jdbc(spark: SparkSession, connection: Mapping[str, str], **read: object) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(connection, **read)).load()


def hash_predicates(number: str, parts: int) -> list[str]:
    """Conditions that split a read by a number the database finds for each row.

    number: SQL of the database for a whole number, 0 or more, as a hash of a text key. Rows for
        which it is NULL are read with the first part.
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    first = f"MOD({number}, {parts}) = 0 OR ({number}) IS NULL"
    return [first, *(f"MOD({number}, {parts}) = {n}" for n in range(1, parts))]


def range_predicates(column: str, borders: Sequence[str]) -> list[str]:
    """Conditions that split a read by ranges of a text key; borders ascend."""
    if list(borders) != sorted(set(borders)) or not borders:
        raise ValueError("borders must ascend")
    quoted = ["'" + border.replace("'", "''") + "'" for border in borders]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:])]
    return [f"{column} < {quoted[0]} OR {column} IS NULL", *middle, f"{column} >= {quoted[-1]}"]


def jdbc_parts(
    connection: Mapping[str, str],
    predicates: Sequence[str],
    query: str | None = None,
    table: str | None = None,
    fetch_size: int = 10_000,
) -> dict[str, object]:
    """Arguments of a JDBC read with a task for each condition; each row must meet just one."""
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    if "url" not in connection or not predicates:
        raise ValueError("the read needs a url and conditions")
    rest = {name: value for name, value in connection.items() if name != "url"}
    return {
        "url": connection["url"],
        "table": _jdbc_source(query, table),
        "predicates": list(predicates),
        "properties": {**rest, "fetchsize": str(fetch_size)},
    }


def read_jdbc_parts(
    spark: SparkSession, connection: Mapping[str, str], predicates: Sequence[str], **read: object
) -> DataFrame:
    return spark.read.jdbc(**jdbc_parts(connection, predicates, **read))


def name_by_position(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Name the columns of a result in their order."""
    return rows.toDF(*names)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """CSV with a header; an empty cell is NULL.

    multiline: cells may hold line breaks. A file is then read by one task.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )


def read_csv_with_lists(
    spark: SparkSession, path: str, schema: T.StructType, lists: Sequence[str]
) -> DataFrame:
    """CSV in which some cells hold a list written as a Python literal."""
    rows = read_csv(spark, path, schema)
    return rows.withColumns({name: literal_list(F.col(name)) for name in lists})


def scan(table: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """Only the rows and columns needed; both reach the scan."""
    rows = table if where is None else table.where(where)
    return rows.select(*columns)
