from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from tests.conftest import DATA
from vitrine.llm import queries, sharding
from vitrine.llm.shared import table, with_positions
from pyspark.sql import functions as F


def check(rows, shards):
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in slots)


def test_query(workers):
    docs = {r["doc_id"]: r for r in table(workers, DATA, "documents").collect()}
    rows = queries.QUERIES["op1_interleaved_shards"](workers, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    check(rows, 16)
    for row in rows:
        raw = docs[row["doc_id"]]["text"].encode()
        assert (row["size"], row["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert row["law"] == "rows" and row["grown_shard"] is None


@pytest.mark.parametrize("shards", [1, 3, 16, 100])
def test_mixture(workers, shards):
    rows = workers.range(700).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 400, "hot").when(F.col("id") < 410, None)
        .otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"),
    )
    found = sharding.interleave(rows, shards).collect()
    check(found, shards)
    by_source = Counter((r["source"], r["shard"]) for r in found)
    whole = Counter(r["source"] for r in found)
    for source, n in whole.items():
        counts = [by_source[source, s] for s in range(shards)]
        # the rows before a place are off their share by less than one for each source, so both
        # ends of a shard may be off by that many rows of all
        off = 1 + 2 * len(whole) * n / 700
        assert all(abs(c - n / shards) <= off for c in counts), (source, counts)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(rows, shards).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_messy(messy, nothing):
    rows = sharding.interleave(messy, 4)
    assert [n for n in rows.columns if n.lower() in ("shard", "slot")] == ["shard", "slot"]
    check(rows.collect(), 4)
    assert rows.count() == messy.count()
    assert sharding.interleave(nothing, 4).count() == 0


def test_positions(messy):
    placed = with_positions(
        messy, [F.col("doc_id").asc_nulls_first(), F.length("text")], group="source", add="n_chars"
    )
    groups = defaultdict(list)
    for row in placed.collect():
        groups[row["source"]].append(row)
    assert sum(map(len, groups.values())) == messy.count()
    for rows in groups.values():
        rows.sort(key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(len(rows)))
        total = 0
        for row in rows:
            assert row["before"] == total
            total += row["n_chars"]


def test_written_shards(workers, tmp_path):
    rows = workers.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    sharding.write_shards(sharding.interleave(rows, 4), f"{tmp_path}/out")
    back = workers.read.parquet(f"{tmp_path}/out")
    assert sorted(r[0] for r in back.select("doc_id").collect()) == list(range(20))
    assert len(list((tmp_path / "out").glob("shard=*"))) == 4
