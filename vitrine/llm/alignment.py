"""Which tokens of two tokenizers cover the same bytes, and how often pairs of them do."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.shared import byte_letters, extended, few_at_once, materialize
from vitrine.llm.token_counts import Cutter

#: Pieces, and tokens of them, that a task remembers the encoding of; then it starts anew.
REMEMBER, TOKENS = 400_000, 4_000_000
#: Bytes of text aligned at once, and bytes whose pairs are counted together.
ALIGNED, BLOCK = 1 << 19, 2 << 20
#: Bits of an id; a link is (document, first id, second id) in one number.
ID = 20
#: Pairs of tokens in a group up to which all are written down and then counted.
FEW = 64
SPACE = "▁"


class _Numbers(dict):
    """The number of each piece seen; a piece not seen before gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number


class _Known:
    """The number of each piece seen, and the tokens of the numbers."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.numbers = _Numbers()
        self.tokens, self.starts = array("i"), array("q", [0])

    def learn(self, pieces: list[str]) -> np.ndarray:
        """The numbers of the pieces, which are looked up once."""
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        new, self.numbers.new = self.numbers.new, []
        for tokens in self.encode(new):
            self.tokens.extend(tokens)
            self.starts.append(len(self.tokens))
        return numbers


class Encoder:
    """Tokens of whole texts by way of pieces that no token crosses, each encoded once."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable, token_bytes: list[bytes]):
        if len(token_bytes) > 1 << ID:
            raise ValueError("too many tokens")
        self.cut, self.encode = cut, encode
        self.bytes = pa.array(token_bytes, type=pa.binary())
        self.sizes = pc.cast(pc.binary_length(self.bytes), pa.int64())
        self.known = _Known(encode)

    def __call__(self, texts: list[str]) -> pa.ListArray:
        """The tokens of each text."""
        if len(self.known.numbers) > REMEMBER or len(self.known.tokens) > TOKENS:
            self.known = _Known(self.encode)
        pieces: list[str] = []
        counts = [0]
        for text in texts:
            pieces += self.cut(text)
            counts.append(len(pieces))
        known, self.known = self.known, _Known(self.encode)
        numbers = known.learn(pieces)
        self.known = known  # not kept if its pieces could not be encoded
        starts, tokens = np.array(known.starts), np.array(known.tokens)
        first = starts[numbers]
        sizes = starts[numbers + 1] - first
        ends = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
        return _lists(pa.array(tokens[where], pa.int32()), ends[counts[1:]])


@lru_cache(maxsize=2)
def byte_level(path: str) -> Encoder:
    """A byte-level BPE file; special tokens inside a text are plain text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = Tokenizer.from_file(path).model
    letters = {letter: byte for byte, letter in byte_letters().items()}
    written = str.maketrans({chr(byte): letter for letter, byte in letters.items()})
    named = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    token_bytes = [b""] * (max(named.values()) + 1)
    for token, number in named.items():
        token_bytes[number] = bytes(letters[c] for c in token)

    def encode(pieces: list[str]) -> list[list[int]]:
        letters = (piece.encode("utf-8").decode("latin-1").translate(written) for piece in pieces)
        return [[token.id for token in model.tokenize(piece)] for piece in letters]

    return Encoder(Cutter(path), encode, token_bytes)


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Encoder:
    """A sentencepiece BPE file whose pieces hold spaces at their beginning only.

    The text is given with the space in front that the model adds. A text is cut before each run
    of spaces, where no merge can cross.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    token_bytes, plain = [], True
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        plain &= SPACE not in piece.lstrip(SPACE)
        token_bytes.append(
            bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace(SPACE, " ").encode()
        )
    if not plain:
        raise ValueError("pieces of this model go on beyond a space")
    space = model.piece_to_id(SPACE)
    segments = re.compile(f"[ {SPACE}]+[^ {SPACE}]*").findall

    def encode(pieces: list[str]) -> list[list[int]]:
        found = model.encode([piece[1:] for piece in pieces], num_threads=1)
        # of a text that is nothing but the space in front the model makes no token
        return [tokens or [space] for tokens in found]

    return Encoder(segments, encode, token_bytes)


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values)


class _Side:
    """The tokens of some texts by one encoder: lists flattened, with parents and byte ends."""

    def __init__(self, lists: pa.ListArray, encoder: Encoder):
        self.ids = lists.flatten()
        self.doc = pc.list_parent_indices(lists)
        sizes = encoder.sizes.take(self.ids)
        # segmented cumulative sums: the running total less that at the beginning of the text
        total = np.concatenate([[0], pc.cumulative_sum(sizes).to_numpy()])
        last = lists.offsets.to_numpy()
        self.sizes = total[last[1:]] - total[last[:-1]]
        base = pa.array(total[last[:-1]]).take(self.doc)
        self.ends = pc.subtract(pa.array(total[1:]), base)
        data = encoder.bytes.take(self.ids).buffers()[2]
        self.joined = data.to_pybytes()[: int(total[-1])] if data else b""

    def gives(self, expected: list[bytes]) -> np.ndarray:
        """Which texts the tokens give back."""
        if self.sizes.tolist() == list(map(len, expected)) and self.joined == b"".join(expected):
            return np.ones(len(expected), dtype=bool)
        after = np.cumsum(self.sizes)
        pieces = (self.joined[end - size : end] for end, size in zip(after, self.sizes))
        return np.array([piece == text for piece, text in zip(pieces, expected)], dtype=bool)

    def keys(self) -> pa.Table:
        key = pc.bit_wise_or(pc.shift_left(self.doc.cast(pa.int64()), 32), self.ends)
        return pa.table({"key": key, "at": np.arange(len(self.ids))})


def align(texts: list[str | None], one: Encoder, two: Encoder) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups) of each text; its different links, and how often each.

    Offsets at which tokens of both encoders end cut the tokens into groups; within a group all are
    linked. A text that is null, empty, or not given back by the tokens of both has no tokens. Links
    are in order of their text.
    """
    n = len(texts)
    given = [" " + text if text else "" for text in texts]
    expected = [text.encode("utf-8") for text in given]
    lists = one(given), two(given)
    sides = [_Side(tokens, encoder) for tokens, encoder in zip(lists, (one, two))]
    right = sides[0].gives(expected) & sides[1].gives(expected)
    if not right.all():
        given = [text if good else "" for text, good in zip(given, right)]
        sides = [_Side(encoder(given), encoder) for encoder in (one, two)]
    shared = sides[0].keys().join(
        sides[1].keys(), "key", join_type="inner", right_suffix="_two", use_threads=False
    )
    names, starts, sizes = [], [], []
    for side, at in zip(sides, ("at", "at_two")):
        closes = np.zeros(len(side.ids), dtype=bool)
        closes[shared[at].to_numpy()] = True
        ends = np.flatnonzero(closes) + 1
        starts.append(np.concatenate([[0], ends[:-1]]) if len(ends) else ends)
        sizes.append(ends - starts[-1])
        names.append(pc.binary_join(_lists(side.ids.cast(pa.string()), ends), ","))
    doc = sides[0].doc.to_numpy()[starts[0]].astype(np.int64)
    links, times = _links(sides, starts, sizes, doc)
    n_groups = np.bincount(doc, minlength=n)
    written = _lists(pc.binary_join_element_wise(names[0], names[1], "|"), np.cumsum(n_groups))
    n_links = np.zeros(n, dtype=np.int64)
    np.add.at(n_links, links >> 2 * ID, times)
    documents = pa.table(
        {
            "n_a": np.bincount(sides[0].doc, minlength=n),
            "n_b": np.bincount(sides[1].doc, minlength=n),
            "n_groups": n_groups,
            "n_links": n_links,
            "groups": pc.binary_join(written, ";"),
        }
    )
    return documents, links, times


def _links(
    sides: list[_Side], starts: list[np.ndarray], sizes: list[np.ndarray], doc: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The different links, in order of their document, and how often each occurs."""
    a, b = (side.ids.to_numpy().astype(np.int64) for side in sides)
    pairs = sizes[0] * sizes[1]
    few = np.flatnonzero(pairs <= FEW)
    n = pairs[few]
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(sizes[1][few], n)
    left = a[np.repeat(starts[0][few], n) + nth // width]
    right = b[np.repeat(starts[1][few], n) + nth % width]
    parts = [((np.repeat(doc[few], n) << 2 * ID) | (left << ID) | right, np.ones(len(nth), dtype=np.int64))]
    many = np.flatnonzero(pairs > FEW)
    if len(many):
        # a large group costs its different ids, which are counted before they meet
        counted = []
        for ids, start, size, name in zip((a, b), starts, sizes, "ab"):
            sizes_here = size[many]
            offset = np.arange(int(sizes_here.sum())) - np.repeat(np.cumsum(sizes_here) - sizes_here, sizes_here)
            here = ids[np.repeat(start[many], sizes_here) + offset]
            table = pa.table({"group": np.repeat(many, sizes_here), name: here})
            counts = table.group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
            counted.append(counts.rename_columns(["group", name, f"n_{name}"]))
        met = counted[0].join(counted[1], "group", join_type="inner", use_threads=False)
        of = doc[met["group"].to_numpy()] << 2 * ID
        link = of | (met["a"].to_numpy() << ID) | met["b"].to_numpy()
        parts.append((link, met["n_a"].to_numpy() * met["n_b"].to_numpy()))
    table = pa.table({"link": np.concatenate([p[0] for p in parts]), "times": np.concatenate([p[1] for p in parts])})
    summed = table.group_by("link", use_threads=False).aggregate([("times", "sum")])
    links, times = summed["link"].to_numpy(), summed["times_sum"].to_numpy()
    of_doc = links >> 2 * ID
    if (np.diff(of_doc) < 0).any():
        order = np.argsort(of_doc, kind="stable")
        links, times = links[order], times[order]
    return links, times


_FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "block long, a array<int>, b array<int>, docs array<int>, ends array<int>, used binary, links binary"
#: Blocks handed to Python at once.
AT_ONCE = 8


class _Block:
    """Documents whose different pairs are written once, and named by their number."""

    def __init__(self, number: int, schema: pa.Schema):
        self.number, self.schema = number, schema
        self.parts: list[pa.RecordBatch] = []
        self.facts: list[pa.Table] = []
        self.links: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = self.rows = 0

    def add(self, part: pa.RecordBatch, texts: list, one: Encoder, two: Encoder, size: int) -> None:
        facts, links, times = align(texts, one, two)
        sha = [
            hashlib.sha256(text.encode()).hexdigest() if n else ""
            for text, n in zip(facts["groups"].to_pylist(), facts["n_a"].to_pylist())
        ]
        self.parts.append(part)
        self.facts.append(facts.drop_columns(["groups"]).append_column("sha", pa.array(sha, pa.string())))
        self.links.append(links + (self.rows << 2 * ID))
        self.times.append(times)
        self.rows += len(texts)
        self.size += size

    def batch(self) -> pa.RecordBatch:
        """One row: what is known of the documents as lists, and their pairs."""
        links = np.concatenate(self.links)
        coded = pa.array(links & ((1 << 2 * ID) - 1)).dictionary_encode()
        codes = coded.dictionary.to_numpy()
        docs = np.bincount(coded.indices, minlength=len(codes))
        ends = np.cumsum(np.bincount(links >> 2 * ID, minlength=self.rows))
        own = pa.Table.from_batches(self.parts), pa.concat_tables(self.facts)
        columns = [column.combine_chunks() for table in own for column in table.columns]
        ints = (codes >> ID, codes & ((1 << ID) - 1), docs, ends)
        row = [
            *(_lists(column, np.array([len(column)])) for column in columns),
            pa.array([self.number], pa.int64()),
            *(pa.array([values.astype(np.int32)], pa.list_(pa.int32())) for values in ints),
            pa.array([_packed(coded.indices.to_numpy())]),
            pa.array([_packed(np.concatenate(self.times))]),
        ]
        row = [column.cast(field.type) for column, field in zip(row, self.schema)]
        return pa.RecordBatch.from_arrays(row, schema=self.schema)


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1)


def aligned(
    docs: DataFrame,
    one: Callable,
    two: Callable,
    text: str,
    keep: tuple[str, ...],
    sizes: tuple[int, int] = (ALIGNED, BLOCK),
) -> DataFrame:
    """A row for each block of documents: lists of what is known of each, the different pairs (a, b)
    with the number of documents that hold them linked, and which pairs each document has."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(
        *[F.col(f"`{name}`").alias(k) for k, name in zip(kept, keep)], F.col(f"`{text}`").alias("text")
    )
    facts = extended(slim.select(*kept).schema, _FACTS)
    listed = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in facts])
    schema = extended(listed, _PAIRS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = one(), two()
        task = TaskContext.get().partitionId() << 32
        block = _Block(task, arrow)
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy()
            start = 0
            while start < whole.num_rows:
                upto = np.cumsum(lengths[start : start + 512])
                count = max(1, int(np.searchsorted(upto, sizes[0], "right")))
                part = whole.slice(start, count)
                size = int(upto[part.num_rows - 1])
                block.add(part.select(kept), part["text"].to_pylist(), first, second, size)
                start += part.num_rows
                if block.size >= sizes[1]:
                    yield block.batch()
                    task += 1
                    block = _Block(task, arrow)
        if block.rows:
            yield block.batch()

    return slim.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): the documents that hold a pair linked, and whether no b has more with a."""
    per_block = blocks.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("pair"))
    counts = per_block.groupBy("pair.a", "pair.b").agg(F.sum("pair.docs").alias("count"))
    counts = materialize(counts)
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("a") == F.col("of")).select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best")
    )


def _summed(row: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The documents of a block, with the sums over the counts of their pairs."""
    n_pairs = len(row["a"][0])
    told = row["told"][0].values
    count, best = np.zeros(n_pairs, dtype=np.int64), np.zeros(n_pairs, dtype=np.int64)
    if told is not None:
        at = told.field("at").to_numpy()
        count[at] = told.field("count").to_numpy()
        best[at] = told.field("best").to_numpy(zero_copy_only=False)
    used, links = _unpacked(row["used"][0].as_py()), _unpacked(row["links"][0].as_py())
    ends = np.concatenate([[0], row["ends"][0].values.to_numpy()])
    upto = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ends])
    made = {"n_best": upto(links * best[used]), "count_sum": upto(links * count[used])}
    columns = [
        pa.array(made[f.name], f.type) if f.name in made else row[f.name][0].values.cast(f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def alignment(
    docs: DataFrame,
    one: Callable[[], Encoder],
    two: Callable[[], Encoder],
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    sizes: tuple[int, int] = (ALIGNED, BLOCK),
) -> DataFrame:
    """(keep..., n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    `one` and `two` make the encoders; they run once in each task. Both must give back a space and
    the text: see align, byte_level, sentence_pieces. A link is an occurrence of a token of one and a
    token of the other in one group. The count of a pair of ids is the number of rows that hold it
    linked; n_best are the links whose count is the highest of their first id, ties included;
    count_sum adds the counts of all links.

    Arrow-native: lists of tokens are flattened with their parent indices, byte ends are segmented
    cumulative sums, an Acero hash join finds the ends both share, keyed by (document, end), and
    Table.group_by counts the pairs before they leave the task (in large groups the ids as well,
    before Acero joins them). Spark merges the counts of blocks of some 2 MB of text, of which every
    pair is one row, and hands each block the counts of its own pairs; so the hottest pair is one row
    for each block. A block is one row, read back a few at a time.

    Null and empty texts have zeros and an empty groups_sha256, and so has a text that the tokens
    don't give back. Repeated rows are rows of their own. An empty table gives an empty result.
    Very long texts are aligned alone. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = materialize(aligned(docs, one, two, text, keep, sizes))
    counts = pair_counts(blocks)
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "pair"))
    pairs = pairs.select(F.col("block").alias("of"), "at", "pair.a", "pair.b").join(counts, ["a", "b"])
    told = materialize(
        pairs.groupBy("of").agg(F.collect_list(F.struct("at", "count", "best")).alias("told"))
    )
    kept = [f"k{i}" for i in range(len(keep))]
    facts = T.StructType([T.StructField(n, blocks.schema[n].dataType.elementType) for n in kept])
    schema = extended(extended(facts, _FACTS), "n_best long, count_sum long")
    arrow = to_arrow_schema(schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _summed(batch.slice(i, 1), arrow)

    with few_at_once(docs.sparkSession, AT_ONCE):
        joined = blocks.join(told, F.col("block") == F.col("of"), "left")
        summed = materialize(joined.mapInArrow(total, schema))
    back = [F.col(k).alias(name) for k, name in zip(kept, keep)]
    return summed.select(
        *back, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
