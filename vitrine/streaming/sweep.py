"""Day sweep over files that keep arriving.

The batch sweep (operators.ordering.sweep_days) reads a range of days in one scan. Here each run
takes only the files added since the last one and appends their rows to the table of day folders.
The checkpoint makes every file count once, also when a run is broken off and started again.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def append_new_days(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    time: str = "created",
    day: str = "snapshot_date",
    files: str | None = None,
    files_per_day: int = 4,
) -> StreamingQuery:
    """Append the rows of all new parquet files below ``source`` and stop.

    files: pattern of the file names to take.
    files_per_day: tasks, and so files, a day's rows are dealt to in one run.
    """
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    rows = reader.parquet(source).withColumn(day, F.to_date(time))
    # Without this, every task writes a file for each day it meets.
    rows = rows.repartition(day, F.pmod(F.xxhash64(time), F.lit(files_per_day)))
    return (
        rows.writeStream.format("parquet")
        .partitionBy(day)
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
