"""Removal of lines that many pages of one site share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import fresh, materialize


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line(line: Column) -> Column:
    """What makes two lines equal: all but blanks at their ends."""
    return F.trim(line)


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def common_lines(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.05,
    least_pages: int = 3,
    sure: float = 0.0,
) -> DataFrame:
    """(site, lines): the lines of each site that are on more than `ratio` of its pages.

    A page is a different text: copies of a text are one page, so what is copied is no boilerplate
    for that. A line counts once for each page. With `sure`, a line must be on so many pages that
    one of just that ratio would not get there by chance: on more than e + sure * sqrt(e) pages, if e
    is the ratio's share of the site's pages. So a bar holds at every size of a site, higher in
    proportion on small ones. Lines on fewer than `least_pages` pages are never common: two pages
    that share their lines may be two states of one. Blank lines don't count.

    First hashes of lines are counted, in place before the shuffle; only lines whose hash is common
    are counted again as they are, so a chance match of hashes removes nothing. A site has at most
    (mean lines of a page) / ratio common lines.
    """
    pages = docs.select(_name(host).alias("site"), _name(text).alias("text")).filter("text is not null")
    pages = pages.withColumn("page", F.xxhash64("text"))
    totals = pages.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    distinct = F.array_distinct(F.transform(lines_of(F.col("text")), _line))
    rows = pages.select("site", "page", F.explode(distinct).alias("line")).filter("line != ''")
    expected = F.lit(ratio) * F.col("pages")
    enough = (F.col("n") >= least_pages) & (F.col("n") > expected + F.lit(sure) * F.sqrt(expected))

    def common(counted: DataFrame) -> DataFrame:
        named = totals.withColumnRenamed("site", "of")
        joined = counted.join(named, F.col("site").eqNullSafe(F.col("of")))
        return joined.filter(enough).drop("of", "n", "pages")

    hashed = rows.select("site", "page", F.xxhash64("line").alias("hash"))
    hashes = materialize(common(hashed.groupBy("site", "hash").agg(F.count_distinct("page").alias("n"))))
    named = hashes.withColumnRenamed("site", "of")
    again = rows.withColumn("key", F.xxhash64("line")).join(
        named, F.col("site").eqNullSafe(F.col("of")) & (F.col("key") == F.col("hash")), "left_semi"
    )
    found = common(again.groupBy("site", "line").agg(F.count_distinct("page").alias("n")))
    return found.groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_common_lines(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.05,
    least_pages: int = 3,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
    sure: float = 0.0,
) -> DataFrame:
    """The rows, their texts without the lines common on their site, with n_lines and n_dropped,
    or what `counts` names them.

    Site-relative frequency: see common_lines. The small table of common lines is joined by site;
    the texts themselves are shuffled only if that table is too large for Spark to broadcast, and
    then the join may split a hot site.

    Every row stays, even if no line of it does (its text is then empty). A null text stays null
    and has 0 lines. Null sites are one site. Rows with one text are one page; all of them lose the
    same lines. An empty table gives an empty result. Columns named as the counts are replaced.
    """
    names = [n for n in docs.columns if n.lower() not in [c.lower() for c in counts]]
    site, lines = fresh(docs, "site", "lines")
    common = materialize(common_lines(docs, host, text, ratio, least_pages, sure))
    common = common.select(F.col("site").alias(site), F.col("lines").alias(lines))
    joined = docs.join(common, _name(host).eqNullSafe(F.col(site)), "left")
    whole = lines_of(_name(text))
    kept = F.filter(whole, lambda line: ~F.array_contains(F.col(lines), _line(line)))
    kept = F.when(F.col(lines).isNull(), whole).otherwise(kept)
    count = F.when(_name(text).isNull(), 0).otherwise(F.size(whole)).cast("long")
    left = F.when(_name(text).isNull(), 0).otherwise(F.size(kept)).cast("long")
    return joined.select(
        *[F.array_join(kept, "\n").alias(n) if n == text else _name(n) for n in names],
        count.alias(counts[0]),
        (count - left).alias(counts[1]),
    )
