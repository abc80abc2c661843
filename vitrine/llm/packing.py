"""Packing documents into sequences of equal length, first fit decreasing in random groups."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import byte_letters, extended, fresh, materialize

#: Chunks, and words, that a worker remembers the ids of, if not told otherwise; some 500 bytes for both.
REMEMBER = 200_000
#: Longer chunks are encoded each time.
LONG_CHUNK = 48
#: A chunk that is one word and perhaps one mark: letters that lower-case one by one.
WORD_AND_MARK = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")


class Remembered(dict):
    """Finds what it doesn't hold yet by a function; long keys are not kept."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__({"": b""})
        self.find, self.most = find, most

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= LONG_CHUNK:
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self[""] = b""


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer's pieces never reach over white space, so a text's ids are those of its chunks
    between spaces and line ends, one after the other. It lower-cases and cuts between letters and
    marks, so a chunk like "Word," has the ids of "word" and of ",". A word of plain letters goes
    to the tokenizer's merges as it is; any other chunk goes through the whole tokenizer. What was
    met is remembered, up to a bound.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Remembered(self._word, remember)
        self.others = Remembered(self._any, remember // 5)
        self.chunks = Remembered(self._chunk, remember)

    def _any(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(self.letters[byte] for byte in word.encode())
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        match = WORD_AND_MARK.fullmatch(chunk)
        if not match:
            return self.others[chunk]
        return self.words[match[1].lower()] + self.others[match[2]]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        for held in (self.words, self.others, self.chunks):
            held.trim()
        find = self.chunks.__getitem__
        return [b"".join(map(find, (t or "").replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str, remember: int = REMEMBER) -> Encoder:
    """One for all tasks of a worker process, so that they share what is remembered."""
    return Encoder(path, remember)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end: int = 1,
    length: int = 2048,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    batch: int = 128,
    remember: int = REMEMBER,
) -> DataFrame:
    """Rows (keep..., start, length, ids, doc_tokens): each document's ids, cut at every `length`.

    A document is its token ids without special ones, then `end`; ids are little-endian unsigned
    32-bit numbers in a binary. A null text counts as empty: only `end`. Whole texts are encoded,
    a small batch of documents at a time. A worker remembers the ids of `remember` words and chunks,
    then starts anew: more of its memory against less of its time, never other results. Columns named as the new ones are not kept.
    """
    kept = [n for n in keep if n.lower() not in ("start", "length", "ids", "doc_tokens")]
    new = "start long, length long, ids binary, doc_tokens long"
    schema = extended(docs.select(*kept).schema, new)
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remember)
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                part = whole.slice(first, batch)
                row, start, size, ids, total = [], [], [], [], []
                for k, found in enumerate(encode(part.column(text).to_pylist())):
                    found += tail
                    n = len(found) // 4
                    for at in range(0, n, length):
                        row.append(k)
                        start.append(at)
                        size.append(min(length, n - at))
                        ids.append(found[4 * at : 4 * (at + length)])
                        total.append(n)
                taken = pa.array(row, type=pa.int64())
                columns = [part.column(name).take(taken) for name in kept]
                columns += [pa.array(x, type=pa.int64()) for x in (start, size)]
                columns += [pa.array(ids, type=pa.binary()), pa.array(total, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the first bin with room for it.

    The free room of the bins is held by a tournament tree: a node has the larger of its two
    children, so walking down from the root finds the leftmost bin that fits in log n steps.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    where = np.zeros(n, dtype=np.int64)
    offset = np.zeros(n, dtype=np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[item] = node - leaves
        offset[item] = capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
    return where, offset


def pack(
    rows: DataFrame,
    identity: tuple[str, ...] = ("doc_id", "start"),
    length: str = "length",
    capacity: int = 2048,
    group: int = 4000,
    seed: int = 31,
) -> DataFrame:
    """The rows with sequence_id and offset (gapless from 0 in each sequence).

    First fit decreasing in groups of about `group` rows that a seeded hash deals out, so groups
    are alike in size and mix whatever the rows hold; a group is one small task. Sequences are
    numbered as group * 2^32 + bin. No row may be longer than `capacity`.

    The rows are shuffled as they are: give lengths and ids of pieces, not their tokens. Null
    identities and repeated rows are rows like others: where a row lies in the written table takes
    part in the hash, so equal rows spread over all groups. An empty table gives an empty result.
    Columns named sequence_id or offset are replaced.
    """
    rows = rows.drop("sequence_id", "offset")
    (dealt,) = fresh(rows, "dealt")
    rows = materialize(rows)
    groups = max(1, -(-rows.count() // group))
    schema = extended(rows.schema, "sequence_id long, offset long")

    def place(key: tuple, held: pa.Table) -> pa.Table:
        held = held.drop_columns([dealt])
        held = held.sort_by([(name, "ascending") for name in (*identity, length)])
        where, offset = first_fit_decreasing(held.column(length).to_numpy(), capacity)
        held = held.append_column("sequence_id", pa.array(where + (key[0].as_py() << 32)))
        return held.append_column("offset", pa.array(offset))

    place_read = F.monotonically_increasing_id()
    of = F.pmod(F.xxhash64(F.lit(seed), *identity, place_read), F.lit(groups)).cast("long")
    found = rows.withColumn(dealt, of).groupBy(dealt).applyInArrow(place, schema)
    return found


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence as one binary, from pack(pieces(...))."""
    held = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held")
    )
    joined = F.aggregate(F.col("held.ids"), F.lit(b""), lambda all_, ids: F.concat(all_, ids))
    return held.select("sequence_id", joined.alias("ids"))
