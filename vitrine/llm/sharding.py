"""Shards that all hold the same mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import fresh, materialize, seeded, with_positions


def interleave(
    rows: DataFrame,
    shards: int = 16,
    source: str = "source",
    identity: tuple[str, ...] = ("doc_id",),
    seed: int = 17,
) -> DataFrame:
    """The rows with `shard` (0 to shards - 1) and `slot` (from 0, gapless in each shard).

    Proportional stratified interleaving: the rows of each source are shuffled by a seeded hash of
    `identity` and ranked; rank r of n rows gets the fractional rank (r + u) / n, u being a phase
    of the source, so that sources of one row don't all meet in the middle. All rows are ordered
    by fractional rank and cut into runs of equal length: row counts of shards differ by one at
    most, and each holds nearly the same share of every source.

    Both rankings go by ranges (see with_positions), so a source with a third of all rows is
    spread over tasks. Give only the columns that are needed, as all of them are shuffled twice.

    Null sources are one source. Repeated rows are rows of their own. With fewer rows than shards
    some shards are empty; an empty table gives an empty result. Columns named shard or slot are
    replaced.
    """
    rows = rows.drop("shard", "slot")
    mix, rank, phase, share, of, count = fresh(
        rows, "mix", "rank", "phase", "share", "of", "count"
    )
    keys = [F.col(name) for name in identity]
    ties = [F.col(name).asc_nulls_first() for name in identity]
    shuffled = materialize(rows.withColumn(mix, seeded(seed, *keys)))
    ranked = with_positions(shuffled, [F.col(mix), *ties], group=source, position=rank)
    sizes = shuffled.groupBy(F.col(source).alias(of)).agg(F.count(F.lit(1)).alias(count))
    # the first 13 hex digits of a hash, as a fraction of 16^13
    digits = F.substring(seeded(seed, F.lit("phase"), F.col(source)), 1, 13)
    ranked = ranked.withColumn(phase, F.conv(digits, 16, 10).cast("double") / F.lit(16.0**13))
    placed = ranked.join(sizes, F.col(source).eqNullSafe(F.col(of))).withColumn(
        share, (F.col(rank) + F.col(phase)) / F.col(count)
    )
    placed = placed.select(*rows.columns, mix, share)
    total = shuffled.count()
    placed = with_positions(placed, [F.col(share), F.col(mix), *ties], position="slot")
    # exact in integers: the shard's first row is the least p with p * shards >= shard * total
    shard = F.expr(f"(slot * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("slot") - first).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """The rows of interleave() in one folder for each shard, in order of their slots."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
