"""Near duplicates by SimHash, found around the anchor points of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.llm.shared import add_columns, fresh, materialize

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's word shingles.

    A-Z are lower-cased, words lie between ASCII white space, shingles count as often as they
    occur. Fewer words than `size` make one shingle, no words the fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    hashes = np.fromiter((hashed(b" ".join(run), seed) for run in runs), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        block = hashes[start : start + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(
    docs: DataFrame, text: str = "text", size: int = 3, seed: int = 42, keep: list[str] | None = None
) -> DataFrame:
    """The rows with `simhash`, the 64 bits as a long. A null text counts as empty."""

    def make():
        return lambda texts: {
            "simhash": pa.array([fingerprint(t, size, seed) for t in texts], type=pa.int64())
        }

    kept = [n for n in (docs.columns if keep is None else keep) if n.lower() != "simhash"]
    return add_columns(docs, text, "simhash long", make, keep=kept)


def blocks_for(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, r) of the blocks of which one differs in one bit at most.

    max_bits // 2 + 1 blocks share the 64 bits; if each had two or more different bits, there would
    be more than max_bits. Of each block the first 2^r - 1 bits count, the length of a Hamming code.
    """
    n = max_bits // 2 + 1
    width = BITS // n
    return [(i * width, (width + 1).bit_length() - 1) for i in range(n)]


def _syndrome(word: Column, r: int) -> Column:
    """XOR of the places (from 1) of the bits that are set; 0 for words of the code."""
    places = range(1, 1 << r)
    parts = []
    for k in range(r):
        mask = sum(1 << (p - 1) for p in places if p >> k & 1)
        parity = F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))) % 2
        parts.append(F.shiftleft(parity, k))
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def _flips(r: int) -> list[list[int]]:
    """By syndrome: what to flip to reach each code word within distance 2; the first is nearest."""
    bit = lambda place: 1 << (place - 1)
    out: list[list[int]] = [[0]]
    for s in range(1, 1 << r):
        two = [bit(p) | bit(p ^ s) for p in range(1, 1 << r) if p != s and p < p ^ s]
        out.append([bit(s), *two])
    return out


def _anchored(rows: DataFrame, word: Column, r: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Homes and visits (keys..., anchor, print) for a word of 2^r - 1 bits of each print."""
    flips = F.array(*[F.array(*[F.lit(f).cast("long") for f in row]) for row in _flips(r)])
    near = rows.select(*keys, "print", word.alias("word"))
    near = near.select(*keys, "print", "word", F.get(flips, _syndrome(F.col("word"), r)).alias("flips"))
    home = F.col("word").bitwiseXOR(F.get("flips", F.lit(0))).alias("anchor")
    visit = F.col("word").bitwiseXOR(F.col("flip")).alias("anchor")
    return (
        near.select(*keys, home, "print"),
        near.select(*keys, "print", "word", F.explode("flips").alias("flip")).select(*keys, visit, "print"),
    )


def _word(print_: Column, first: int, r: int) -> Column:
    mask = F.lit((1 << ((1 << r) - 1)) - 1).cast("long")
    return F.shiftrightunsigned(print_, first).bitwiseAND(mask)


def _rotated(print_: Column, by: int) -> Column:
    """The bits from `by` on come first."""
    if by % BITS == 0:
        return print_
    return F.shiftrightunsigned(print_, by).bitwiseOR(F.shiftleft(print_, BITS - by))


def _meet(homes: DataFrame, visits: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    homes, visits = homes.withColumnRenamed("print", "a"), visits.withColumnRenamed("print", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = homes.join(visits, keys).filter((F.col("a") != F.col("b")) & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def links(
    prints: DataFrame, max_bits: int = 3, column: str = "simhash", crowd: int = 2000
) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints that differ in max_bits bits or fewer.

    Anchor points: the 64 bits are cut into blocks of which at least one must agree but for one
    bit. The anchors of a block are the words of a perfect Hamming code: each point has exactly
    one within distance 1 (the covering radius). A fingerprint is at home at that anchor, and is
    copied to every anchor within distance 2 (radius plus the block's threshold): 2^(r-1), 16 for
    31 bits. Of two prints that agree in a block but for one bit, each therefore visits the
    other's home. Prints are compared only there, and by all 64 bits.

    At an anchor that is home to more than `crowd` prints, those that meet there must agree in one
    part of the remaining bits as well, but for one bit; so they meet at anchors of those parts
    instead, and no link is lost. The joins may split what is still hot.

    Expects each fingerprint once.
    """
    blocks = blocks_for(max_bits)
    rows = prints.select(F.col(column).alias("print"))
    parts = []
    for number, (first, r) in enumerate(blocks):
        home, visit = _anchored(rows, _word(F.col("print"), first, r), r, [])
        block = F.lit(number).alias("block")
        parts.append((home.select(block, "*"), visit.select(block, "*")))
    homes, visits = _union([h for h, _ in parts]), _union([v for _, v in parts])
    at = ["block", "anchor"]
    width = BITS // len(blocks)
    if width == BITS:
        return _meet(homes, visits, at, max_bits).distinct()
    crowded = materialize(homes.groupBy(*at).count().filter(F.col("count") > crowd).select(*at))
    if crowded.isEmpty():
        return _meet(homes, visits, at, max_bits).distinct()
    found = [_meet(homes.join(crowded, at, "left_anti"), visits, at, max_bits)]
    home, visit = homes.join(crowded, at, "left_semi"), visits.join(crowded, at, "left_semi")
    number_of_parts = max_bits // 2 + 1
    part_width = (BITS - width) // number_of_parts
    r = (part_width + 1).bit_length() - 1
    for number, (first, _) in enumerate(blocks):
        for part in range(number_of_parts):
            word = _word(_rotated(F.col("print"), first + width), part * part_width, r)
            here = F.col("block") == number
            inner = ["block", "outer"]
            crowd_home = home.filter(here).withColumnRenamed("anchor", "outer")
            crowd_visit = visit.filter(here).withColumnRenamed("anchor", "outer")
            own, _ = _anchored(crowd_home, word, r, inner)
            _, others = _anchored(crowd_visit, word, r, inner)
            found.append(_meet(own, others, [*inner, "anchor"], max_bits))
    return _union(found).distinct()


def classes(
    docs: DataFrame,
    max_bits: int = 3,
    size: int = 3,
    seed: int = 42,
    text: str = "text",
    identity: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, simhash) of the documents, and (simhash, first), the first row of its class.

    `mark` is a hash of the text; first rows are found by id, null last, then mark.
    Texts are hashed once and only ids, marks and fingerprints go on. Equal fingerprints are
    brought together before anything is compared, so copies cost one row.
    """
    slim = docs.select(F.col(identity).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    marked = materialize(with_fingerprints(slim, "text", size, seed, keep=["id", "mark"]))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    prints = materialize(marked.groupBy("simhash").agg(F.min(order).alias("first")))
    label = components(links(prints, max_bits))
    known = materialize(
        prints.join(label, prints["simhash"] == label["node"], "left").select(
            "simhash", "first", F.coalesce("component", "simhash").alias("component")
        )
    )
    firsts = known.groupBy("component").agg(F.min("first").alias("first"))
    return marked, known.select("simhash", "component").join(firsts, "component").drop("component")


def near_duplicates(
    docs: DataFrame,
    max_bits: int = 3,
    size: int = 3,
    seed: int = 42,
    text: str = "text",
    identity: str = "doc_id",
) -> DataFrame:
    """(identity, simhash, component_id): the least id that links of max_bits or fewer lead to.

    Null texts count as empty; all empty texts share the fingerprint 0, linked like any other.
    Repeated ids are rows of their own. A component of null ids only has a null component_id. An
    empty table gives an empty result. No other columns are read.
    """
    marked, known = classes(docs, max_bits, size, seed, text, identity)
    return marked.join(known, "simhash").select(
        F.col("id").alias(identity), "simhash", F.col("first.id").alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame,
    max_bits: int = 3,
    size: int = 3,
    seed: int = 42,
    text: str = "text",
    identity: str = "doc_id",
) -> DataFrame:
    """The rows of which one for each component stays: that of the least id (see near_duplicates).

    Of rows that repeat an id with the same text, one stays. Rows without an id come last. Null and
    empty texts are copies of each other (fingerprint 0). All columns are kept; an empty table stays
    empty. Whole rows are shuffled once: the join's key is a hash of id and text, and rows that it
    has brought together need no second shuffle to leave one of each.
    """
    _, known = classes(docs, max_bits, size, seed, text, identity)
    kept = known.select("first.id", "first.mark").distinct()
    kept = kept.withColumn("place", F.xxhash64("id", "mark"))
    mark, place = fresh(docs, "mark", "place")
    marked = docs.withColumn(mark, F.xxhash64(F.col(f"`{text}`")))
    marked = marked.withColumn(place, F.xxhash64(F.col(f"`{identity}`"), F.col(mark)))
    own = marked[f"`{identity}`"]
    # Not a key of the join: it would take part in the partitioning.
    alike = F.coalesce(own == kept["id"], own.isNull() & kept["id"].isNull())
    same = (marked[place] == kept["place"]) & (marked[mark] == kept["mark"]) & alike
    survivors = marked.join(kept, same, "left_semi")
    return survivors.dropDuplicates([place, mark, identity]).drop(mark, place)
