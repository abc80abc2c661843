"""A Merkle manifest of a dataset: every row a leaf, with its proof up to one root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import fresh, materialize, with_positions

#: Nodes under one parent, and levels that are nested in one row: 3 ** 6 leaves, some 150 kB.
FANOUT, DEPTH = 3, 6
_WAY = "array<struct<before string, after string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as part of a leaf: its UTF-8 length, a colon, the value; a dash for null."""
    text = value.cast("string")
    written = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(written)


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def fold(start: Column, way: Column) -> Column:
    """The root that a leaf leads to along a way of siblings."""
    return F.aggregate(way, start, lambda h, step: digest(F.concat(step["before"], h, step["after"])))


def siblings(way: Column) -> Column:
    """The digests a proof consists of, level by level, left to right."""
    return F.array_join(F.transform(way, lambda step: F.concat(step["before"], step["after"])), "")


def _nested(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, block, top): blocks of fanout ** depth nodes of each tree, nested into one struct.

    `nodes` has tree, place (from 0, without gaps) and node, a struct that begins with its hash. The
    digits of the place are grouped away one after the other, the lowest first; all groupings lie
    within a block, so its rows are shuffled once.
    """
    digits = [f"digit_{k}" for k in range(depth)]
    at = [
        F.expr(f"cast(place div {fanout**k} % {fanout} as int)").alias(name)
        for k, name in enumerate(digits)
    ]
    block = F.expr(f"place div {fanout**depth}").alias("block")
    rows = nodes.select("tree", block, *at, (F.col("place") == 0).alias("first"), "node")
    rows = rows.repartition("tree", "block")
    for k, name in enumerate(digits):
        kids = F.transform(F.sort_array(F.collect_list(F.struct(name, "node"))), lambda kid: kid["node"])
        rows = rows.groupBy("tree", "block", *digits[k + 1 :]).agg(
            F.bool_or("first").alias("first"), kids.alias("kids")
        )
        # All that a tree has at this level: it is the root already and gets no parent.
        alone = F.col("first") & (F.size("kids") == 1)
        hashes = F.col("kids")["hash"]
        own = F.when(alone, hashes[0]).otherwise(digest(F.array_join(hashes, "")))
        node = F.struct(own.alias("hash"), alone.alias("alone"), "kids")
        rows = rows.select("tree", "block", *digits[k + 1 :], "first", node.alias("node"))
    return rows.select("tree", "block", F.col("node").alias("top"))


def _below(node: Column, depth: int, way: Column) -> Column:
    """An array of (item, way) for all the leaves below a nested node."""
    if depth == 0:
        return F.array(F.struct(node["item"].alias("item"), way.alias("way")))
    hashes = node["kids"]["hash"]

    def step(i: Column) -> Column:
        before = F.array_join(F.slice(hashes, F.lit(1), i), "")
        after = F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "")
        own = F.array(F.struct(before.alias("before"), after.alias("after")))
        return F.when(node["alone"], way).otherwise(F.concat(own, way))

    return F.flatten(F.transform(node["kids"], lambda kid, i: _below(kid, depth - 1, step(i))))


def _tiers(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Nested blocks, then nested blocks of their tops, until every tree is one block."""
    tiers = []
    while True:
        blocks = materialize(_nested(nodes, fanout, depth))
        tiers.append(blocks)
        if blocks.where("block > 0").isEmpty():
            return tiers
        item = F.col("block").alias("item")
        nodes = blocks.select(
            "tree",
            F.col("block").alias("place"),
            F.struct(F.col("top.hash").alias("hash"), item).alias("node"),
        )


def _leaves(tiers: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """(tree, item, way, and what else `above` has) for all leaves of all trees.

    `above` has a row (tree, way, ...) for each tree: the way from its root on. Each block meets its
    way in a grouping by block, of one row each, and its leaves come out of the nested struct.
    """
    more = [name for name in above.columns if name not in ("tree", "way")]
    ways = above.select("tree", F.lit(0).cast("long").alias("block"), "way", *more)
    for number, blocks in enumerate(reversed(tiers)):
        both = blocks.unionByName(ways, allowMissingColumns=True)
        met = both.groupBy("tree", "block").agg(
            *[F.first(name, ignorenulls=True).alias(name) for name in ("top", "way", *more)]
        )
        found = met.select(
            "tree", *more, F.explode(_below(F.col("top"), depth, F.col("way"))).alias("leaf")
        ).select("tree", *more, "leaf.item", "leaf.way")
        ways = found.withColumnRenamed("item", "block")
    return found


def with_proofs(
    rows: DataFrame,
    hashed: str,
    order: list[Column],
    group: str | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """The rows with subroot, root and way, an array of (before, after) from the leaf to the root.

    `hashed` is the column with a row's digest. The rows of a group are the leaves of a tree in the
    given order; parents are the digest of `fanout` consecutive ones (of fewer, even one, at the
    end), until one is left, the subroot. The subroots, in order of their group (null first), make
    the tree above them in the same way.

    Nested-struct rollup: the digits of each row's rank are grouped away in blocks of fanout ** depth
    rows, each nesting the structs of the one before; a transform of the nested struct and an explode
    give the proofs, without joins. Tops of blocks are the leaves of the next tier, so a hot group is
    many blocks, and no row holds more than one block.

    Rows should be slim: they are shuffled, texts are not wanted here. Equal rows are leaves of
    their own; rows equal in `order` may take each other's place. A null group is a group. One row
    in one group is its own subroot and root, with an empty way. An empty table gives an empty one.
    Columns named subroot, root or way are replaced.
    """
    kept = [name for name in rows.columns if name.lower() not in ("subroot", "root", "way")]
    (place,) = fresh(rows, "place")
    placed = with_positions(rows.select(*map(_quoted, kept)), order, group, position=place)
    tree = F.col(_name(group)) if group else F.lit(0)
    item = F.struct(*[F.col(_name(n)).alias(f"c{i}") for i, n in enumerate(kept)])
    nodes = placed.select(
        tree.alias("tree"),
        F.col(place).alias("place"),
        F.struct(F.col(_name(hashed)).alias("hash"), item.alias("item")).alias("node"),
    )
    tiers = _tiers(nodes, fanout, depth)
    tops = tiers[-1].select(F.col("tree").alias("item"), F.col("top.hash").alias("hash"))
    ranked = with_positions(tops, [F.col("item").asc_nulls_first()], position="place")
    above = _tiers(
        ranked.select(
            F.lit(0).alias("tree"),
            "place",
            F.struct("hash", F.struct(F.col("item").alias("of"), "hash").alias("item")).alias("node"),
        ),
        fanout,
        depth,
    )
    start = above[-1].select("tree", F.array().cast(_WAY).alias("way"), F.col("top.hash").alias("root"))
    roots = _leaves(above, start, depth).select(
        F.col("item.of").alias("tree"), "way", "root", F.col("item.hash").alias("subroot")
    )
    found = _leaves(tiers, roots, depth)
    back = [F.col(f"item.c{i}").alias(name) for i, name in enumerate(kept)]
    return found.select(*back, "subroot", "root", "way")


def _name(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _quoted(name: str) -> Column:
    return F.col(_name(name))


def manifest(
    docs: DataFrame,
    columns: list[str],
    group: str,
    identity: str,
    changed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """(identity, group, leaf, changed_leaf, subroot, root, way) of every row.

    A leaf is the digest of the named columns (see field). `changed` gives other values for some
    of them: changed_leaf is the leaf the row would have with these, for checking what a proof
    detects; it is the leaf itself where nothing differs. Texts are hashed where they are read and
    not shuffled. Leaves of a group ascend by identity, null first, then leaf, so that reruns agree
    on repeated ids. Null values, empty and very long texts are leaves like any other.
    """
    values = [_quoted(name) for name in columns]
    other = [(changed or {}).get(name, _quoted(name)) for name in columns]
    slim = docs.select(
        _quoted(identity).alias("id"),
        _quoted(group).alias("of"),
        leaf(*values).alias("leaf"),
        (leaf(*other) if changed else F.lit(None).cast("string")).alias("changed_leaf"),
    )
    slim = materialize(slim)
    proofs = with_proofs(
        slim, "leaf", [F.col("id").asc_nulls_first(), F.col("leaf").asc()], "of", fanout, depth
    )
    return proofs.select(
        F.col("id").alias(identity),
        F.col("of").alias(group),
        "leaf",
        F.coalesce("changed_leaf", "leaf").alias("changed_leaf"),
        "subroot",
        "root",
        "way",
    )
