"""Exact token counts at every prefix of a text, by a dynamic programme over its bytes."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import byte_letters, extended

#: White space as the tokenizer's pattern has it, and its contractions.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Pieces, letters of them, and pairs of tokens that a task remembers; then it starts anew.
PIECES, LETTERS, PAIRS = 1_000_000, 20_000_000, 400_000


#: Ranges of code points that all versions of the Unicode tables class alike; tested.
SETTLED = "\\x00-\u052f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20b0\u2190-\u23cf\u2500-\u27bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\ufe0f\U0001f300-\U0001f64f"


@lru_cache(maxsize=1)
def disputed() -> regex.Pattern | None:
    """Code points that the tokenizer library's tables class otherwise than those of `regex` here."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    every = "".join(map(chr, points))
    differ: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = np.ones(len(every), dtype=bool)
        for _, (start, end) in pre_tokenizers.Split(Regex(f"{kind}+"), "removed").pre_tokenize_str(every):
            theirs[start:end] = False
        ours = np.zeros(len(every), dtype=bool)
        for found in regex.finditer(f"{kind}+", every):
            ours[found.start() : found.end()] = True
        differ.update(every[i] for i in np.flatnonzero(theirs != ours))
    return regex.compile("[" + "".join(map(regex.escape, sorted(differ))) + "]") if differ else None


class Cutter:
    """The pieces of a text within which a byte-level tokenizer merges, as its library cuts them.

    `regex` cuts, which is faster. A text with a code point that its tables class otherwise than the
    library's goes to the library; the tables are compared once, when a text needs it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).pre_tokenizer
        marks = "|".join(map(regex.escape, CONTRACTIONS))
        self.fast = regex.compile(
            rf"{marks}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
            rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        ).findall
        self.unsettled = regex.compile(f"[^{SETTLED}]").search

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self.unsettled(text):
            odd = disputed()
            if odd is not None and odd.search(text):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.fast(text)


class Merges:
    """Byte pair encoding of pieces of text, with counts for each of their prefixes.

    Bytes are held as the letters that stand for them in the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.model = Tokenizer.from_file(path).model
        self.letters = str.maketrans({chr(byte): letter for byte, letter in byte_letters().items()})
        # The vocabulary by last letter, the one before, and so on; "" marks a token's beginning.
        self.endings: dict = {}
        for token in spec["model"]["vocab"]:
            node = self.endings
            for letter in reversed(token):
                node = node.setdefault(letter, {})
            node[""] = True
        self.stable: dict[tuple[str, str], bool] = {}

    def in_letters(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def size(self, letters: str) -> int:
        return len(self.model.tokenize(letters))

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens, side by side, are what their bytes are encoded as."""
        found = self.model.tokenize(left + right)
        known = len(found) == 2 and found[0].value == left
        if len(self.stable) > PAIRS:
            self.stable.clear()
        self.stable[left, right] = known
        return known

    def prefix_counts(self, pieces: list[str]) -> Iterator[list[int]]:
        """For each piece, in letters, the tokens of its first letter, first two letters and so on,
        each prefix encoded for itself.

        A row of tokens is an encoding if and only if all its neighbours fit. So the last token of
        a prefix is the one token that ends there and fits the last token of the prefix before it,
        and the count is one more than that prefix's. What holds for a prefix holds for every piece
        that begins with it: in sorted order each piece goes on from what it shares with the one
        before.
        """
        last: list[str] = [""]
        counts: list[int] = [0]
        before = ""
        stable, root = self.stable, self.endings
        for piece in pieces:
            shared = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], counts[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                node, starts = root, []
                for start in range(end - 1, -1, -1):
                    node = node.get(piece[start])
                    if node is None:
                        break
                    if "" in node:
                        starts.append(start)
                for start in reversed(starts):
                    token = piece[start:end]
                    if start:
                        known = stable.get((last[start], token))
                        if not (self.fits(last[start], token) if known is None else known):
                            continue
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            before = piece
            yield counts[1:]


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """The same array, or a longer one that begins with it."""
    if size <= len(held):
        return held
    out = np.zeros(max(size, 2 * len(held)), dtype=held.dtype)
    out[: len(held)] = held
    return out


class PrefixCounter:
    """Token counts of text[:1], text[:2], ... (characters), each as the tokenizer gives them."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.cut = Cutter(path)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # the counts of all pieces one after the other, where each begins, and which are blank
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.blank = np.zeros(1 << 12, dtype=bool)

    def learn(self, pieces: set[str]) -> None:
        """Add the counts at each character of pieces that are not known."""
        merges = self.merges
        new = sorted((merges.in_letters(p), p) for p in pieces.difference(self.known))
        if not new:
            return
        at, end = len(self.known), len(self.known) + len(new)
        self.known.update((piece, at + i) for i, (_, piece) in enumerate(new))
        found: list[int] = []
        sizes = []
        for (letters, piece), counts in zip(new, merges.prefix_counts([x for x, _ in new])):
            if len(letters) != len(piece):
                ends = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
                counts = [counts[e - 1] for e in ends]
            if len(piece) == 3 and piece in CONTRACTIONS:
                # cut short, it's no contraction: the mark and the letters are pieces of their own
                counts[1] = counts[0] + merges.size(letters[1:2])
            found += counts
            sizes.append(len(counts))
        ends = self.starts[at] + np.cumsum(sizes)
        self.starts = _room(self.starts, end + 1)
        self.starts[at + 1 : end + 1] = ends
        self.flat = _room(self.flat, int(ends[-1]))
        self.flat[self.starts[at] : ends[-1]] = found
        self.blank = _room(self.blank, end)
        self.blank[at:end] = [not piece.strip() for _, piece in new]

    def counts(self, cut: list[str]) -> np.ndarray:
        """Counts at each character of a text without special tokens, from its known pieces."""
        if not cut:
            return np.zeros(0, dtype=np.int32)
        ids = np.fromiter(map(self.known.__getitem__, cut), dtype=np.int64, count=len(cut))
        first, after = self.starts[ids], self.starts[ids + 1]
        sizes = after - first
        ends = np.cumsum(sizes)
        tokens = self.flat[after - 1]
        base = (np.cumsum(tokens) - tokens).astype(np.int32)
        where = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        out = self.flat[where] + np.repeat(base, sizes)
        # a prefix that ends where a run of white space does has that run as its last piece
        for k in np.flatnonzero(self.blank[ids[:-1]]).tolist():
            here = int(ends[k])
            if cut[k + 1][:1].isspace():
                run = cut[k] + cut[k + 1][:1]
                self.learn({run})
                out[here] = base[k] + self.flat[self.starts[self.known[run] + 1] - 1]
        return out

    def with_special(self, text: str) -> np.ndarray:
        parts = self.special.split(text)
        out, base = [], 0
        for k in range(0, len(parts), 2):
            mark = parts[k + 1] if k + 1 < len(parts) else ""
            # up to its last character the mark is ordinary text that goes on from the part
            cut, own = self.cut(parts[k] + mark[:-1]), self.cut(parts[k])
            self.learn({*cut, *own})
            out.append(self.counts(cut) + base)
            counted = self.counts(own)
            base += int(counted[-1]) if len(counted) else 0
            if mark:
                base += 1
                out.append(np.asarray([base], dtype=np.int32))
        return np.concatenate(out)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > PIECES or len(self.flat) > LETTERS:
            self.forget()
        special = [bool(self.special.search(text)) if text else False for text in texts]
        cut = [[] if s else self.cut(t or "") for t, s in zip(texts, special)]
        self.learn(set().union(*cut))
        return [self.with_special(t) if s else self.counts(c) for t, s, c in zip(texts, special, cut)]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for all tasks of a worker process, so that they share what is remembered."""
    return PrefixCounter(path)


def prefix_counts(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    batch: int = 128,
) -> DataFrame:
    """Rows (keep..., prefix_tokens): element i is the exact token count of the first i characters.

    `tokenizer` is a byte-level BPE file. Special tokens inside a text count as one. A null text
    counts as empty and has an empty array. Whole texts are read, a small batch at a time; what is
    remembered of their words is bounded. Columns named prefix_tokens are not kept.

    Any question on truncation is then a lookup: see tokens_in and fits_in.
    """
    kept = [name for name in keep if name.lower() != "prefix_tokens"]
    schema = extended(docs.select(*kept).schema, "prefix_tokens array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                part = whole.slice(first, batch)
                found = count(part.column(text).to_pylist())
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in kept] + [lists], names=schema.names
                )

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def tokens_in(prefix_tokens: Column, characters: Column | None = None) -> Column:
    """Tokens of the first so many characters (all, if None); beyond the end, of all."""
    size = F.size(prefix_tokens)
    at = size if characters is None else F.least(characters, size)
    return F.when(at > 0, F.get(prefix_tokens, at - 1)).otherwise(0).cast("long")


def fits_in(prefix_tokens: Column, budget: int) -> Column:
    """The most characters whose tokens, counted for themselves, are within the budget."""
    size = F.size(prefix_tokens)
    good = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1))
    return F.when(size > 0, F.coalesce(F.array_max(good), F.lit(0))).otherwise(0)
