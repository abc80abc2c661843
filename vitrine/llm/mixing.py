"""Mixing sources to target weights; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import fresh, materialize, seeded, with_positions

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str, cycle: tuple[int, ...]) -> DataFrame:
    """Sources in order of code points, null last, with weights that repeat."""
    ranked = with_positions(sources, [F.col(source).asc_nulls_last()], position="nth")
    given = F.array(*[F.lit(weight) for weight in cycle])
    return ranked.withColumn(
        "weight", F.get(given, (F.col("nth") % len(cycle)).cast("int")).cast("long")
    ).drop("nth")


def fill(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """Sources (source_size, weight) with `target`: capped water-filling.

    The level is what is left to give, divided by the weights that are not clamped. Sources whose
    weight times level is above epochs times their size are clamped there, and the rest is shared
    again, until none is above. Each round is one aggregate over the sources; only four sums come
    to the driver. Every round but the last clamps a source at least.
    """
    cap = epochs * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("size")).first()["size"] or 0
    budget = share * whole
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= cap
        state = sources.agg(
            F.sum(F.when(free, F.col("weight"))).alias("weights"),
            F.sum(F.when(~free, cap)).alias("clamped"),
        ).first()
        if not state["weights"]:
            return sources.withColumn("target", cap.cast("double"))
        # sums of whole and half numbers: exact
        next_level = (budget - (state["clamped"] or 0)) / state["weights"]
        if next_level == level:
            break
        level = next_level
    return sources.withColumn(
        "target", F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    )


def mix(
    docs: DataFrame,
    size: Column,
    share: float = 1.5,
    epochs: int = 2,
    cycle: tuple[int, ...] = (5, 2, 1),
    source: str = "source",
    identity: str = "doc_id",
    seed: int = 29,
) -> DataFrame:
    """The rows with size, source_size, target (of the source) and repetitions.

    Targets: fill(). A source that is to give t of its s words is taken floor(t / s) times as a
    whole; what is left, less than s words, is taken from its documents in the order of a seeded
    hash, each whole document whose middle lies before that point. So the words taken miss the
    target by half a document at most, and no document is taken more than `epochs` times.

    The documents taken once more are the first of that order, so a source is described by its
    last one: only ids, sizes and hashes are put in order, by ranges (a hot source is spread over
    tasks), and the documents themselves meet one small row for each source, without a shuffle.

    Null sources are one source; null texts have size 0. Of rows that agree in source, id and size
    with the last one taken, as many are taken as the target asks for, in the order of a hash of
    their columns: if that is not all of them, those rows alone are written and numbered by ranges. Sources without words take nothing. An empty table gives an empty result.
    Columns named as the new ones are replaced.
    """
    new = ["size", "source_size", "target", "repetitions"]
    kept = [name for name in docs.columns if name.lower() not in new]
    key = seeded(seed, F.col(identity))
    slim = materialize(
        docs.select(
            F.col(source).alias("source"), key.alias("mix"), F.col(identity).alias("id"), size.alias("size")
        )
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = materialize(sizes.withColumnRenamed("source", "of"))
    targets = fill(cycled_weights(sizes, "of", cycle), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("whole", F.coalesce(whole, F.lit(0)))
    order = [F.col("mix"), F.col("id").asc_nulls_first(), F.col("size")]
    placed = with_positions(slim, order, group="source", add="size")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    first = (F.col("source_size") > 0) & (F.col("whole") < epochs)
    first &= 2 * F.col("before") + F.col("size") <= 2 * rest
    last = (
        placed.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .filter(first)
        .groupBy("source")
        .agg(F.max(F.struct("mix", "id", "size")).alias("last"), F.count(F.lit(1)).alias("n"))
    )
    last = materialize(last.withColumnRenamed("source", "at"))
    here = F.struct("mix", "id", "size")
    ties = slim.join(last, F.col("source").eqNullSafe(F.col("at")))
    ties = ties.groupBy(F.col("source").alias("tied_in")).agg(
        F.count_if(here < F.col("last")).alias("earlier"), F.count_if(here <= F.col("last")).alias("upto")
    )
    plan = materialize(
        targets.join(last, F.col("of").eqNullSafe(F.col("at")), "left")
        .join(ties, F.col("of").eqNullSafe(F.col("tied_in")), "left")
        .select(
            *("of", "source_size", "target", "whole", "last"),
            (F.col("n") - F.col("earlier")).alias("some"),
            (F.col("n") < F.col("upto")).alias("parted"),
        )
    )
    of, goal, total, times, until, some, parted, count = fresh(
        docs, "of", "goal", "total", "times", "until", "some", "parted", "count"
    )
    plan = plan.toDF(of, total, goal, times, until, some, parted)
    joined = docs.withColumn(count, size).join(plan, F.col(source).eqNullSafe(F.col(of)))
    place = F.struct(key.alias("mix"), F.col(identity).alias("id"), F.col(count).alias("size"))

    def shown(rows: DataFrame, taken: Column) -> DataFrame:
        extra = F.coalesce(taken, F.lit(False)).cast("int")
        return rows.select(
            *kept,
            F.col(count).alias("size"),
            F.col(total).alias("source_size"),
            F.col(goal).alias("target"),
            (F.col(times) + extra).cast("int").alias("repetitions"),
        )

    if plan.filter(F.col(parted)).isEmpty():
        return shown(joined, place <= F.col(until))
    tie = F.coalesce(F.col(parted) & (place >= F.col(until)) & (place <= F.col(until)), F.lit(False))
    looks, salt, nth = fresh(joined, "looks", "salt", "nth")
    tied = joined.filter(tie).withColumn(
        looks, F.xxhash64(F.lit(seed), F.struct(*docs.columns).cast("string"))
    )
    tied = tied.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    tied = with_positions(tied, [F.col(looks), F.col(salt)], group=of, position=nth)
    rest = shown(joined.filter(~tie), place <= F.col(until))
    return rest.unionByName(shown(tied, F.col(nth) < F.col(some)))


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    (copy,) = fresh(mixed, "copy")
    times = F.explode(F.sequence(F.lit(1), F.col("repetitions")))
    return mixed.filter("repetitions > 0").withColumn(copy, times).drop(copy)
