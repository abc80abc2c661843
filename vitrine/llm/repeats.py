"""Removal of passages that an earlier document holds, by sorted suffixes around sampled anchors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.deep_shallow import suffix_array
from vitrine.llm.shared import few_at_once, materialize, tasks

#: Bytes of an anchor. Windows of `length` bytes are known by the least anchor they hold.
ANCHOR = 24
#: Bytes of text in a block, blocks whose anchors make up a bucket, and blocks handed to Python at once.
BLOCK, PER_BUCKET, AT_ONCE = 1 << 20, 16, 16
#: Strings written out at once.
CHUNK = 1 << 16
#: Documents that hold an anchor from which on its windows are looked up one by one.
CROWD = 2000
_LAST = np.iinfo(np.int64).max
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    h = (h ^ (h >> np.uint64(29))) * _MIX[3]
    return h ^ (h >> np.uint64(32))


def _grams(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on; `size` is 8 or more."""
    n = len(text) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    words = np.empty(len(text) - 7, dtype="<u8")
    raw = text.tobytes()
    for shift in range(min(8, len(words))):
        part = words[shift::8]
        part[:] = np.frombuffer(raw, dtype="<u8", count=len(part), offset=shift)
    h = np.zeros(n, dtype=np.uint64)
    for k, at in enumerate([*range(0, size - 8, 8), size - 8]):
        h = (h ^ words[at : at + n]) * _MIX[k % 3]
        h ^= h >> np.uint64(31)
    return _mixed(h)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each kind, the kind of each row) of a matrix of bytes.

    Rows are brought together by a hash and told apart by their bytes; if a hash were shared by
    different rows, a kind might come twice, which says the same twice.
    """
    n, width = rows.shape
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    words = padded.view("<u8")
    h = np.zeros(n, dtype=np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MIX[k % 3]
        h ^= h >> np.uint64(31)
    order = np.argsort(_mixed(h), kind="stable")
    together = words[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (together[1:] != together[:-1]).any(axis=1)
    kinds = np.empty(n, dtype=np.int64)
    kinds[order] = np.cumsum(new) - 1
    return order[new], kinds


def _distinct_at(
    raw: np.ndarray, places: np.ndarray, width: int, hashes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same for the strings at some places of a text, given their hashes, without writing them out."""
    if not len(places):
        return places, places
    order = np.argsort(hashes, kind="stable")
    at, h = places[order], hashes[order]
    strings = sliding_window_view(raw, width)
    new = np.ones(len(at), dtype=bool)
    for start in range(1, len(at), CHUNK):
        stop = min(start + CHUNK, len(at))
        same = h[start:stop] == h[start - 1 : stop - 1]
        new[start:stop] = ~same
        some = start + np.flatnonzero(same)
        new[some] = (strings[at[some]] != strings[at[some - 1]]).any(axis=1)
    kinds = np.empty(len(at), dtype=np.int64)
    kinds[order] = np.cumsum(new) - 1
    return order[new], kinds


@dataclass
class _Text:
    """A block of documents, and its runs: places from which windows share their least anchor."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    digests: np.ndarray
    first: np.ndarray

    @classmethod
    def read(cls, blob: bytes, ids: np.ndarray, sizes: np.ndarray) -> _Text:
        raw = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        whole = raw.tobytes()
        digests = np.array(
            [hashlib.sha256(whole[a:b]).digest()[:16] for a, b in zip(starts, ends)], dtype="V16"
        )
        # of equal texts in the block, the one of the least id (and its repetitions) speaks for all
        _, kinds = np.unique(digests, return_inverse=True)
        kinds = kinds.reshape(-1)
        least = np.full(len(ids), _LAST)
        np.minimum.at(least, kinds, ids)
        return cls(raw, starts, ends, ids, digests, least[kinds])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, anchor, first window, last window, hash of the anchor) of each run.

        A window's anchor is the leftmost of those in it with the least hash, so equal windows have
        the same anchor at the same offset. Copies within the block have none.
        """
        hashes = _grams(self.raw, ANCHOR)
        width = length - ANCHOR + 1
        n = len(self.raw) - length + 1
        if n <= 0:
            return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        covered = 1
        while covered < width:
            step = min(covered, width - covered)
            least = np.minimum(least[:-step], least[step:])
            covered += step
        anchors = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(self.ids)), self.ends - self.starts)[:n]
        own = self.ids == self.first
        valid = (np.arange(n) + length <= self.ends[doc]) & own[doc]
        windows = np.flatnonzero(valid)
        if not len(windows):
            return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),)
        at = anchors[windows]
        breaks = np.flatnonzero((np.diff(at) != 0) | (np.diff(windows) != 1)) + 1
        begin = np.concatenate([[0], breaks])
        last = np.concatenate([breaks, [len(windows)]]) - 1
        return doc[windows[begin]], at[begin], windows[begin], windows[last], hashes[at[begin]]


def _blocks(docs: DataFrame, identity: str, text: str, size: int) -> DataFrame:
    """(block, blob, ids, sizes): documents put together, in the order they are read."""
    slim = docs.select(F.col(f"`{identity}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = "block long, blob binary, ids array<long>, sizes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        ids: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            blob = zlib.compress(b"".join(texts), 1)
            sizes = list(map(len, texts))
            return pa.RecordBatch.from_pydict(
                {"block": [number], "blob": [blob], "ids": [ids], "sizes": [sizes]},
                schema=pa.schema(
                    [
                        ("block", pa.int64()),
                        ("blob", pa.binary()),
                        ("ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())),
                    ]
                ),
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for id_, value in zip(part["id"].to_pylist(), part["text"].to_pylist()):
                    data = value.encode("utf-8") if value else b""
                    if texts and held + len(data) > size:
                        yield block()
                        number, texts, ids, held = number + 1, [], [], 0
                    texts.append(data)
                    ids.append(id_)
                    held += len(data)
        if texts:
            yield block()

    return slim.mapInArrow(run, schema)


def _ids(values: pa.ListScalar) -> np.ndarray:
    """The ids of a block; a null one is greater than all others."""
    return values.values.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Text]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            sizes = row["sizes"][0].values.to_numpy(zero_copy_only=False).astype(np.int64)
            yield row, _Text.read(row["blob"][0].as_py(), _ids(row["ids"][0]), sizes)


_SEEN = np.dtype([("hash", "V5"), ("docs", "<u2")])
_COPY = np.dtype([("digest", "V16"), ("id", "<i8")])
_ENTRY_FIELDS = [("key", "<u8"), ("first", "<i8"), ("last", "<i8"), ("l", "u1"), ("r", "u1")]
_FOUND = np.dtype([("entry", "<u4"), ("lo", "u1"), ("hi", "u1"), ("first", "<i8")])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


class _Anchors:
    """The different anchors of a block and its texts, bucket by bucket, in an order that the same
    block always has."""

    def __init__(self, block: _Text, length: int, buckets: int):
        self.block, self.buckets = block, buckets
        self.doc, self.at, self.begin, self.end, self.hash = block.runs(length)
        self.hashes, self.kind = np.unique(self.hash, return_inverse=True)
        self.kind = self.kind.reshape(-1)
        self.places = self._by_bucket(_bucket(self.hashes, buckets))
        _, where = np.unique(block.digests, return_index=True)
        self.copies = where
        heads = np.frombuffer(block.digests[where].tobytes(), dtype="<u8").reshape(-1, 2)[:, 0]
        self.copy_places = self._by_bucket(_bucket(heads, buckets))

    @staticmethod
    def _by_bucket(bucket: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        changes = np.flatnonzero(np.diff(bucket[order])) + 1
        return {int(bucket[part[0]]): part for part in np.split(order, changes) if len(part)}

    def _documents(self) -> np.ndarray:
        """How many documents, told apart by their ids, hold each anchor."""
        ids, number = np.unique(self.block.ids, return_inverse=True)
        pairs = np.unique(self.kind * len(ids) + number.reshape(-1)[self.doc])
        return np.bincount(pairs // max(1, len(ids)), minlength=len(self.hashes))

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        docs = self._documents()
        for bucket in sorted({*self.places, *self.copy_places}):
            here = self.places.get(bucket, np.zeros(0, dtype=np.int64))
            seen = np.zeros(len(here), dtype=_SEEN)
            high = (self.hashes[here] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            seen["hash"] = np.ascontiguousarray(high).view("V5").reshape(-1)
            seen["docs"] = np.minimum(docs[here], 65535)
            where = self.copies[self.copy_places.get(bucket, np.zeros(0, dtype=np.int64))]
            copy = np.zeros(len(where), dtype=_COPY)
            copy["digest"], copy["id"] = self.block.digests[where], self.block.first[where]
            yield bucket, seen.tobytes(), copy.tobytes()

    def told(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(what is known of each anchor: 0 alone, 1 repeated, 2 a crowd; least id of each text)"""
        level = np.zeros(len(self.hashes), dtype=np.uint8)
        least = self.block.first.copy()
        kinds = np.unique(self.block.digests, return_inverse=True)[1].reshape(-1)
        of_kind = np.full(len(self.copies), _LAST)
        for answer in answers:
            bucket = answer["bucket"]
            if bucket in self.places:
                level[self.places[bucket]] = np.frombuffer(answer["seen"], dtype=np.uint8)
            if bucket in self.copy_places:
                of_kind[self.copy_places[bucket]] = np.frombuffer(answer["copies"], dtype="<i8")
        return level, np.minimum(least, of_kind[kinds])


def _shared_anchors(rows: pa.Table, crowd: int) -> pa.Table:
    """For a bucket: which anchors several documents hold, and the least id of each text."""
    seen = [np.frombuffer(x, dtype=_SEEN) for x in rows["seen"].to_pylist()]
    copies = [np.frombuffer(x, dtype=_COPY) for x in rows["copies"].to_pylist()]
    ends, copy_ends = np.cumsum(list(map(len, seen))), np.cumsum(list(map(len, copies)))
    flat, flat_copies = np.concatenate(seen), np.concatenate(copies)
    _, kinds = np.unique(flat["hash"], return_inverse=True)
    docs = np.zeros(len(flat), dtype=np.int64)
    np.add.at(docs, kinds.reshape(-1), flat["docs"])
    docs = docs[kinds.reshape(-1)]
    level = (docs > 1).astype(np.uint8) + (docs > crowd)
    _, kinds = np.unique(flat_copies["digest"], return_inverse=True)
    least = np.full(len(flat_copies), _LAST)
    np.minimum.at(least, kinds.reshape(-1), flat_copies["id"])
    least = least[kinds.reshape(-1)].astype("<i8")
    return pa.table(
        {
            "block": rows["block"],
            "bucket": rows["bucket"],
            "seen": [part.tobytes() for part in np.split(level.astype(np.uint8), ends[:-1])],
            "copies": [part.tobytes() for part in np.split(least, copy_ends[:-1])],
        }
    )


def _entry(length: int) -> np.dtype:
    return np.dtype([*_ENTRY_FIELDS, ("left", "u1", length - ANCHOR), ("right", "u1", length)])


class _Contexts:
    """The different surroundings of a block's repeated anchors, bucket by bucket.

    An entry holds an anchor, the bytes before it (last one first) and those from it on, as far as
    the windows reach that have this anchor. Of an anchor in a crowd each window is an entry of its
    own, looked up by its own hash, so that what differs around it does not gather in one place.
    """

    def __init__(self, block: _Text, anchors: _Anchors, level: np.ndarray, least: np.ndarray, length: int):
        self.length = length
        of_run = level[anchors.kind] if len(anchors.kind) else np.zeros(0, dtype=np.uint8)
        speaks = block.ids[anchors.doc] == least[anchors.doc]
        some, crowd = np.flatnonzero((of_run == 1) & speaks), np.flatnonzero((of_run == 2) & speaks)
        at, begin, end = anchors.at[some], anchors.begin[some], anchors.end[some]
        rows = self._rows(block.raw, anchors.hash[some], at, at - begin, end + length - at)
        index, kinds = _distinct(_bytes(rows))
        counts = anchors.end[crowd] - anchors.begin[crowd] + 1
        first = np.repeat(anchors.begin[crowd] - (np.cumsum(counts) - counts), counts)
        single = first + np.arange(int(counts.sum()))
        keys = _grams(block.raw, length)[single] if len(single) else single.astype(np.uint64)
        windows, window_kinds = _distinct_at(block.raw, single, length, keys)
        none = np.zeros(len(windows), dtype=np.int64)
        more = self._rows(block.raw, keys[windows], single[windows], none, none + length)
        self.entries = np.concatenate([rows[index], more])
        self.kind = np.concatenate([kinds, window_kinds + len(index)])
        self.at = np.concatenate([at, single]).astype(np.int64)
        self.doc = np.concatenate([anchors.doc[some], np.repeat(anchors.doc[crowd], counts)]).astype(np.int64)
        ids = block.ids[self.doc]
        n = len(self.entries)
        least_id, greatest = np.full(n, _LAST), np.full(n, -(1 << 63))
        np.minimum.at(least_id, self.kind, ids)
        np.maximum.at(greatest, self.kind, ids)
        self.entries["first"], self.entries["last"] = least_id, greatest

    def _rows(
        self, raw: np.ndarray, keys: np.ndarray, at: np.ndarray, l: np.ndarray, r: np.ndarray
    ) -> np.ndarray:
        """Entries with l bytes before the places and r from them on."""
        length, before = self.length, self.length - ANCHOR
        rows = np.zeros(len(at), dtype=_entry(length))
        rows["key"], rows["l"], rows["r"] = keys, l, r
        padded = np.concatenate([np.zeros(before, np.uint8), raw, np.zeros(length, np.uint8)])
        around = sliding_window_view(padded, before + length)
        for start in range(0, len(at), CHUNK):
            part = slice(start, start + CHUNK)
            wide = around[at[part]]
            rows["left"][part] = wide[:, :before][:, ::-1] * (np.arange(before) < l[part, None])
            rows["right"][part] = wide[:, before:] * (np.arange(length) < r[part, None])
        return rows

    def by_bucket(self, buckets: int) -> dict[int, np.ndarray]:
        return _Anchors._by_bucket(_bucket(self.entries["key"], buckets))


def _bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize)


def _classes(keys: np.ndarray, letters: np.ndarray, depth: int) -> Callable[[int], np.ndarray]:
    """For a number of letters: a class for each string, equal where that many letters are.

    Different strings are sorted by deep-shallow sorting; neighbours' common lengths part them.
    """
    index, kinds = _distinct(np.concatenate([keys.view(np.uint8).reshape(-1, 8), letters], axis=1))
    order, common = suffix_array(keys[index], letters[index], depth)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    of = place[kinds]
    return lambda size: np.cumsum(common < size)[of]


def _by_window(entries: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The first holder of each window (by its offset before the anchor) of different entries.

    Where a key has one entry, that entry's first holder is that of all its windows. Of the others,
    suffixes from the anchor on and prefixes before it, read backwards, are sorted. Windows that begin
    `o` bytes before the anchor are equal if their prefixes agree for o bytes and their suffixes for
    the rest.
    """
    before = length - ANCHOR
    l, r = entries["l"].astype(np.int64), entries["r"].astype(np.int64)
    offsets = np.arange(before + 1)
    valid = (l[:, None] >= offsets) & (r[:, None] >= length - offsets)
    found = np.where(valid, first[:, None], _LAST)
    _, of_key, per_key = np.unique(entries["key"], return_inverse=True, return_counts=True)
    some = np.flatnonzero(per_key[of_key.reshape(-1)] > 1)
    if not len(some):
        return found
    keys = np.ascontiguousarray(entries["key"][some])
    right, left = (np.ascontiguousarray(entries[name][some]) for name in ("right", "left"))
    # all strings of a key begin with the anchor, unless two anchors share a hash
    by_key = np.argsort(keys, kind="stable")
    same_key = keys[by_key][1:] == keys[by_key][:-1]
    anchors = right[by_key][:, :ANCHOR]
    agree = (anchors[1:] == anchors[:-1]).all(axis=1)
    suffixes = _classes(keys, right, ANCHOR if agree[same_key].all() else 0)
    prefixes = _classes(keys, left, 0)
    for o in offsets.tolist():
        has = np.flatnonzero(valid[some, o])
        if not len(has):
            continue
        both = suffixes(length - o)[has] * (len(some) + 1) + prefixes(o)[has]
        order = np.argsort(both, kind="stable")
        starts = np.concatenate([[0], np.flatnonzero(np.diff(both[order])) + 1])
        least = np.minimum.reduceat(first[some[has]][order], starts)
        found[some[has[order]], o] = np.repeat(least, np.diff(np.concatenate([starts, [len(has)]])))
    return found


def _first_holders(rows: pa.Table, length: int) -> pa.Table:
    """For a bucket: entries some of whose windows an earlier document holds, and from which id on."""
    parts = [np.frombuffer(x, dtype=_entry(length)) for x in rows["entries"].to_pylist()]
    sizes = np.array(list(map(len, parts)))
    all_ = np.concatenate(parts)
    last = all_["last"]
    plain = all_.copy()
    plain["first"] = plain["last"] = 0
    index, kinds = _distinct(_bytes(plain))
    first = np.full(len(index), _LAST)
    np.minimum.at(first, kinds, all_["first"])
    found = _by_window(plain[index], first, length)[kinds]
    earlier = found < last[:, None]
    # neighbouring offsets with the same first holder go on as one
    padded = np.where(earlier, found, _LAST)
    new = np.ones_like(earlier)
    new[:, 1:] = padded[:, 1:] != padded[:, :-1]
    number, lo = np.nonzero(new & earlier)
    closes = np.ones_like(earlier)
    closes[:, :-1] = padded[:, 1:] != padded[:, :-1]
    _, hi = np.nonzero(closes & earlier)
    out = np.zeros(len(number), dtype=_FOUND)
    origin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out["entry"], out["lo"], out["hi"] = number - origin[number], lo, hi
    out["first"] = found[number, lo]
    ends = np.searchsorted(number, np.cumsum(sizes))
    return pa.table(
        {
            "block": rows["block"],
            "bucket": rows["bucket"],
            "found": [part.tobytes() for part in np.split(out, ends[:-1])],
        }
    )


def _spans(
    block: _Text, contexts: _Contexts, answers: list[dict], least: np.ndarray, buckets: int
) -> np.ndarray:
    """Which bytes of the block an earlier document holds."""
    length, size = contexts.length, len(block.raw)
    edges = np.zeros(size + 1, dtype=np.int64)
    places = contexts.by_bucket(buckets)
    order = np.argsort(contexts.kind, kind="stable")
    sorted_kinds = contexts.kind[order]
    for answer in answers:
        found = np.frombuffer(answer["found"], dtype=_FOUND)
        kinds = places[answer["bucket"]][found["entry"]]
        a, b = np.searchsorted(sorted_kinds, kinds), np.searchsorted(sorted_kinds, kinds, "right")
        counts = b - a
        row = np.repeat(np.arange(len(found)), counts)
        where = order[np.repeat(a - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        later = block.ids[contexts.doc[where]] > found["first"][row]
        row, at = row[later], contexts.at[where[later]]
        np.add.at(edges, at - found["hi"][row], 1)
        np.add.at(edges, at - found["lo"][row] + length, -1)
    removed = np.cumsum(edges[:-1]) > 0
    copies = (block.ids > least) & (block.ends - block.starts >= length)
    for number in np.flatnonzero(copies).tolist():
        removed[block.starts[number] : block.ends[number]] = True
    return removed


_KEPT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"


def removed_passages(
    docs: DataFrame,
    length: int = 50,
    text: str = "text",
    identity: str = "doc_id",
    kept: bool = True,
    crowd: int = CROWD,
    block: int = BLOCK,
) -> DataFrame:
    """(identity, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of every row.

    A byte goes if it lies in a string of `length` bytes that also starts in a row of a smaller id;
    strings overlap, lie within one text and are judged on the input. `spans` are the maximal runs of
    bytes that go, `kept` the bytes that stay (null with kept=False), joined.

    Every string of `length` bytes has an anchor, the least by hash of the 24-byte strings in it, so
    equal strings have equal anchors; a fourteenth of all places is one. Texts go into blocks of `block`
    bytes, read three times:
    1. Blocks say which anchors they have, once each and with the number of documents; buckets of
       anchors answer which of them several documents hold, and which texts are copies of a text with
       a smaller id. These are removed whole and take no further part.
    2. Blocks send the surroundings of the repeated anchors, once each, with the least and greatest
       id. Buckets sort the suffixes from each anchor on and the prefixes before it by deep-shallow
       sorting and find for each string its first holder.
    3. Blocks mark the bytes and put together what is left.
    A string that very many documents hold is one row for each block. An anchor with more than `crowd`
    documents is looked up by its whole windows, so different surroundings of one common anchor
    spread over all buckets. Nothing is lost by it, and results are exact: hashes only choose what
    is compared.

    Null and empty texts have no bytes and no spans. A null id is greater than all others, and not
    greater than itself. Rows that repeat an id don't remove each other's bytes. Very long texts are
    blocks of their own. An empty table gives an empty result. Other columns are not read.
    """
    if length < ANCHOR + 1:
        raise ValueError(f"strings must be longer than {ANCHOR} bytes")
    blocks = materialize(_blocks(docs, identity, text, block))
    buckets = max(tasks(docs.sparkSession), blocks.count() // PER_BUCKET)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in _texts(batches):
            rows = list(_Anchors(texts, length, buckets).rows())
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([row["block"][0].as_py()] * len(rows), pa.int64()),
                    "bucket": pa.array([r[0] for r in rows], pa.int64()),
                    "seen": pa.array([r[1] for r in rows], pa.binary()),
                    "copies": pa.array([r[2] for r in rows], pa.binary()),
                }
            )

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in _texts(batches):
            known = _Anchors(texts, length, buckets)
            level, least = known.told(row["answers"][0].as_py())
            found = _Contexts(texts, known, level, least, length)
            places = found.by_bucket(buckets)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([row["block"][0].as_py()] * len(places), pa.int64()),
                    "bucket": pa.array(list(places), pa.int64()),
                    "entries": pa.array([found.entries[p].tobytes() for p in places.values()], pa.binary()),
                }
            )

    def shared(rows: pa.Table) -> pa.Table:
        return _shared_anchors(rows, crowd)

    def holders(rows: pa.Table) -> pa.Table:
        return _first_holders(rows, length)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in _texts(batches):
            known = _Anchors(texts, length, buckets)
            level, least = known.told(row["answers"][0].as_py())
            found = _Contexts(texts, known, level, least, length)
            removed = _spans(texts, found, row["found"][0].as_py() or [], least, buckets)
            yield _results(texts, row["ids"][0].values, removed, kept)

    with few_at_once(docs.sparkSession, AT_ONCE):
        said = blocks.mapInArrow(anchors, "block long, bucket long, seen binary, copies binary")
        answered = said.groupBy("bucket").applyInArrow(
            shared, "block long, bucket long, seen binary, copies binary"
        )
        told = materialize(
            answered.groupBy("block").agg(
                F.collect_list(F.struct("bucket", "seen", "copies")).alias("answers")
            )
        )
        known = blocks.join(told, "block")
        entries = known.mapInArrow(contexts, "block long, bucket long, entries binary")
        holds = entries.groupBy("bucket").applyInArrow(holders, "block long, bucket long, found binary")
        found = materialize(
            holds.where(F.octet_length("found") > 0)
            .groupBy("block")
            .agg(F.collect_list(F.struct("bucket", "found")).alias("found"))
        )
        cleaned = known.join(found, "block", "left").mapInArrow(clean, f"id long, {_KEPT}")
        return materialize(cleaned).withColumnRenamed("id", identity)


def _results(block: _Text, ids: pa.Array, removed: np.ndarray, with_kept: bool) -> pa.RecordBatch:
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    at_start = block.starts[block.ends > block.starts]
    opens[at_start] = removed[at_start]
    begins = np.flatnonzero(opens)
    stops = np.flatnonzero(removed & np.concatenate([~removed[1:] | opens[1:], [True]])) + 1
    doc = np.searchsorted(block.ends, begins, "right")
    upto = np.concatenate([[0], np.cumsum(removed)])
    left = block.raw[~removed].tobytes()
    n_removed = upto[block.ends] - upto[block.starts]
    bounds = np.cumsum(block.ends - block.starts - n_removed)
    parts = [left[a:b] for a, b in zip(np.concatenate([[0], bounds[:-1]]), bounds)]
    n_spans = np.bincount(doc, minlength=len(block.ids))
    spans = pa.StructArray.from_arrays(
        [pa.array(begins - block.starts[doc], pa.int64()), pa.array(stops - block.starts[doc], pa.int64())],
        names=["start", "end"],
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array(block.ends - block.starts, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(n_spans, pa.int64()),
            pa.array([hashlib.sha256(part).hexdigest() for part in parts], pa.string()),
            pa.array(parts if with_kept else [None] * len(parts), pa.binary()),
            pa.ListArray.from_arrays(offsets, spans),
        ],
        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
    )
