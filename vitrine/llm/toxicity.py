"""Toxicity by a learned lexicon that misspelled terms match too, read in their context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import add_columns, materialize

#: Bounds of the fit: labelled rows read, terms and stems learned.
SAMPLE, TERMS = 20_000, 2_000
#: Fewest toxic texts with a term.
LEAST_HITS = 3
#: Lengths of stems: terms that may go on in any way.
STEMS = (4, 5, 6, 7, 8)
#: Terms of this length or more are matched with one edit.
FUZZY_FROM = 5
#: Words on each side that make the context of a term, and words a task remembers.
WINDOW, REMEMBER = 10, 300_000
#: Entries a task counts before it hands them on.
COUNTED = 100_000
WORD = re.compile(r"\w+")
#: Marks and words of quotation in the languages of the texts.
QUOTES = "\"'«»“”„‘’‹›"
REPORTS = frozenset(
    "said says say wrote writes called quote quoted quoting term word sagte sagt schrieb nannte zitat "
    "wort dit disait écrit appelé citation mot dijo dice escribió llamó cita palabra".split()
)
EXACT, STEM, NEAR = 1, 2, 3
N_FEATURES = 7


def held_out(identity: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(identity.cast("string"), F.lit(""))), F.lit(5)) == 0


class Node:
    """A node of the lexicon trie."""

    __slots__ = ("next", "weight")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.weight: float | None = None


@dataclass
class Lexicon:
    """Terms and stems with their weights, and what a word matches."""

    terms: dict[str, float]
    stems: dict[str, float]
    root: Node = field(init=False, repr=False)

    def __post_init__(self):
        self.root = Node()
        # halves of terms, with the lengths of words that are one edit away
        self.heads: set[tuple[str, int]] = set()
        self.tails: set[tuple[str, int]] = set()
        for term, weight in self.terms.items():
            if len(term) < FUZZY_FROM:
                continue
            node = self.root
            for letter in term:
                node = node.next.setdefault(letter, Node())
            node.weight = weight
            half, sizes = len(term) // 2, (len(term) - 1, len(term), len(term) + 1)
            self.heads |= {(term[:half], size) for size in sizes}
            self.tails |= {(term[half:], size) for size in sizes}
        self.head_sizes = sorted({len(head) for head, _ in self.heads})
        self.tail_sizes = sorted({len(tail) for tail, _ in self.tails})
        self.stem_sizes = sorted({len(stem) for stem in self.stems}, reverse=True)

    def match(self, word: str) -> tuple[int, float] | None:
        """(kind, weight) of the best entry: exact terms, then stems, then terms one edit away."""
        if word in self.terms:
            return EXACT, self.terms[word]
        for size in self.stem_sizes:
            if word[:size] in self.stems and len(word) >= size:
                return STEM, self.stems[word[:size]]
        if not self._may_be_near(word):
            return None
        weight = self._near(word)
        return None if weight is None else (NEAR, weight)

    def _may_be_near(self, word: str) -> bool:
        """One edit leaves one half of a term as it is: a sure and cheap test before the trie."""
        size = len(word)
        return any((word[:n], size) in self.heads for n in self.head_sizes) or any(
            (word[-n:], size) in self.tails for n in self.tail_sizes
        )

    def _near(self, word: str) -> float | None:
        """Runs the word's Levenshtein automaton for one edit along the trie.

        The automaton's states are bits: bit i of `same` (of `off`) says that the path so far and
        the first i letters of the word differ by no (by one) edit. A branch on which no state is
        left is not followed.
        """
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        whole = (1 << (len(word) + 1)) - 1
        accept = 1 << len(word)
        best = None
        todo = [(self.root, 1, 3 & whole)]
        while todo:
            node, same, off = todo.pop()
            if node.weight is not None and (same | off) & accept:
                best = node.weight if best is None else max(best, node.weight)
            for letter, child in node.next.items():
                hit = places.get(letter, 0)
                next_same = (same & hit) << 1
                next_off = ((off & hit) << 1 | same | same << 1 | next_same << 1) & whole
                if next_same | next_off:
                    todo.append((child, next_same, next_off))
        return best


class Reader:
    """Features of texts under a lexicon; what words match is remembered, up to a bound."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, float]] = {}

    def features(self, text: str | None) -> list[float]:
        """Zeros if no word of the text matches.

        Abusive and quoted weight; the greatest weight in a window of words; numbers of matches by
        kind. A match is quoted if a quotation mark stands right before or after it in its window
        of words on both sides, or a word of report stands before it.
        """
        lowered = (text or "").lower()
        words = WORD.findall(lowered)
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) > REMEMBER:
                self.seen, self.hits, new = set(), {}, set(words)
            for word in new:
                found = self.lexicon.match(word)
                if found:
                    self.hits[word] = found
            self.seen |= new
        out = [0.0] * N_FEATURES
        if not self.hits or self.hits.keys().isdisjoint(words):
            return out
        spans = list(WORD.finditer(lowered))
        recent: list[tuple[int, float]] = []
        for at, span in enumerate(spans):
            found = self.hits.get(span[0])
            if not found:
                continue
            kind, weight = found
            if self._quoted(lowered, spans, at):
                out[1] += weight
                weight *= 0.5
            else:
                out[0] += weight
            recent = [(i, w) for i, w in recent if at - i <= 2 * WINDOW] + [(at, weight)]
            out[2] = max(out[2], sum(w for _, w in recent))
            out[2 + kind] += 1
        density = sum(out[3:6]) / len(spans)
        return [*(math.log1p(x) for x in out[:6]), 100 * density / (1 + 100 * density)]

    @staticmethod
    def _quoted(text: str, spans: list, at: int) -> bool:
        first, last = max(0, at - WINDOW), min(len(spans) - 1, at + WINDOW)
        before = text[spans[first - 1].end() if first else 0 : spans[at].start()]
        after = text[spans[at].end() : spans[last + 1].start() if last + 1 < len(spans) else None]
        marked = any(mark in before for mark in QUOTES) and any(mark in after for mark in QUOTES)
        return marked or any(s[0] in REPORTS for s in spans[max(0, at - 4) : at])


@dataclass
class Model:
    """A lexicon and the weights of the features; no lexicon: the score is 0."""

    lexicon: Lexicon
    weights: list[float]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        reach = self.weights[0] + features @ np.asarray(self.weights[1:])
        return 1.0 / (1.0 + np.exp(-np.clip(reach, -30, 30)))


def _evidence(hit: float, miss: float, toxic: float, clean: float) -> float:
    """G squared of a term in `hit` of the toxic and `miss` of the clean texts."""
    n, total = hit + miss, toxic + clean
    out = 0.0
    for seen, all_ in ((hit, toxic), (miss, clean)):
        for count, expected in ((seen, n * all_ / total), (all_ - seen, (total - n) * all_ / total)):
            if count > 0 and expected > 0:
                out += 2 * count * math.log(count / expected)
    return out


def _entries(word: str) -> list[tuple[str, bool]]:
    """The word as a term, and its beginnings as stems."""
    if not 3 <= len(word) <= 40:
        return []
    return [(word, False), *((word[:n], True) for n in STEMS if len(word) >= n)]


def _counts(texts: DataFrame) -> DataFrame:
    """(entry, is_stem, hit, miss): the number of toxic and clean texts with each term and stem.

    Counted within each task first, in a table of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> pa.RecordBatch:
            keys = list(held[True] | held[False])
            columns = [
                pa.array([k[0] for k in keys], type=pa.string()),
                pa.array([k[1] for k in keys], type=pa.bool_()),
                pa.array([held[True][k] for k in keys], type=pa.int64()),
                pa.array([held[False][k] for k in keys], type=pa.int64()),
            ]
            for counter in held.values():
                counter.clear()
            return pa.RecordBatch.from_arrays(columns, names=["entry", "is_stem", "hit", "miss"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                held[bool(toxic)].update({e for word in words for e in _entries(word)})
                if sum(map(len, held.values())) > COUNTED:
                    yield out()
        yield out()

    counted = texts.mapInArrow(run, "entry string, is_stem boolean, hit long, miss long")
    return counted.groupBy("entry", "is_stem").agg(
        F.sum("hit").alias("hit"), F.sum("miss").alias("miss")
    )


def _in_contexts(texts: DataFrame, entries: set[tuple[str, bool]]) -> DataFrame:
    """(entry, is_stem, hit, miss): numbers of different pairs of neighbours in toxic and clean texts.

    A text that was copied often says no more than one: its words have the same neighbours again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, bool, bool, str]] = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = ["", *WORD.findall((text or "").lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:]):
                    for entry in _entries(word):
                        if entry in entries:
                            found.add((*entry, bool(toxic), f"{before} {after}"))
            rows = list(found)
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)],
                names=["entry", "is_stem", "toxic", "context"],
            )

    seen = texts.mapInArrow(run, "entry string, is_stem boolean, toxic boolean, context string")
    return seen.distinct().groupBy("entry", "is_stem").agg(
        F.count_if("toxic").alias("hit"), F.count_if(~F.col("toxic")).alias("miss")
    )


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents that are not held out.

    The sample is the first ids by a hash, so it is the same at every run. It has a fixed bound, so
    it is sent to every task. Of rows with one id that with the least hash of its text is taken; one
    for each id and task is shuffled.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(sample)
    some = some.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic"))
    found = docs.join(F.broadcast(some), F.col("doc_id") == F.col("of"))
    least = F.min(F.struct(F.xxhash64(F.col(text)), F.col(text).alias("text"))).alias("least")
    return found.groupBy("of", "toxic").agg(least).select("least.text", "toxic")


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Words and stems that speak for toxic texts; at most TERMS of each come to the driver."""
    sums = texts.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    toxic, clean = float(sums["toxic"] or 0), float(sums["all"] - (sums["toxic"] or 0))
    if not toxic or not clean:
        return Lexicon({}, {})
    counted = materialize(_counts(texts).filter(F.col("hit") + F.col("miss") >= LEAST_HITS))
    # of so many entries, chance alone gives one this much evidence (G squared)
    bar = 2 * math.log(max(2, counted.count()))
    often = (F.col("hit") >= LEAST_HITS) & (F.col("hit") / toxic >= 10 * F.col("miss") / clean)
    some = counted.filter(often).orderBy(F.col("hit").desc(), "miss", "entry", "is_stem")
    some = {(r["entry"], r["is_stem"]) for r in some.limit(20 * TERMS).collect()}
    kept: dict[bool, dict[str, tuple[float, float]]] = {True: {}, False: {}}
    found = [
        (_evidence(min(r["hit"], toxic), min(r["miss"], clean), toxic, clean), r)
        for r in _in_contexts(texts, some).collect()
    ]
    for evidence, r in sorted(found, key=lambda x: (-x[0], x[1]["entry"])):
        odds = (r["hit"] + 0.5) / (toxic + 1) / ((r["miss"] + 0.5) / (clean + 1))
        if evidence >= bar and odds >= 10 and len(kept[r["is_stem"]]) < TERMS:
            kept[r["is_stem"]][r["entry"]] = (min(math.log(odds), 8.0), r["hit"])
    terms = {term: weight for term, (weight, _) in kept[False].items()}
    return Lexicon(terms, _best_stems(kept[True]))


def _best_stems(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Of stems that begin one another, the longest with nearly all the matches of the shortest."""
    out: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if any(stem.startswith(short) or short.startswith(stem) for short in out):
            continue
        best = stem
        for longer in sorted((s for s in found if s.startswith(stem)), key=len):
            if longer.startswith(best) and found[longer][1] >= 0.9 * found[stem][1]:
                best = longer
        out[best] = found[best][0]
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from at most `sample` labelled documents.

    The features of those documents (numbers, no texts) come to the driver and a logistic
    regression is fitted there. Without toxic or without clean labels every score is 0.
    """
    texts = materialize(training_rows(docs, labels, text, sample))
    lexicon = learn_lexicon(texts)
    if not lexicon.terms and not lexicon.stems:
        return Model(lexicon, [])
    featured = _featured(texts, lexicon, "text", ["toxic"])
    held = featured.select("toxic", "features").toPandas()
    x = np.stack(held["features"].to_numpy())
    y = held["toxic"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # rows come in any order, sums of doubles must not
    return Model(lexicon, logistic(x[order], y[order]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> list[float]:
    """Weights (constant first) by Newton's method; the penalty keeps separable cases finite."""
    full = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([1e-6, *([penalty] * x.shape[1])])
    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (y - p) - ridge @ w
        bend = (full * (p * (1 - p))[:, None]).T @ full + ridge
        step = np.linalg.solve(bend + 1e-9 * np.eye(len(w)), slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _featured(rows: DataFrame, lexicon: Lexicon, text: str, keep: list[str]) -> DataFrame:
    entries = (lexicon.terms, lexicon.stems)

    def make():
        read = Reader(Lexicon(*entries))
        return lambda texts: {
            "features": pa.array([read.features(t) for t in texts], type=pa.list_(pa.float64()))
        }

    return add_columns(rows, text, "features array<double>", make, keep=keep)


def with_scores(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    keep: list[str] | None = None,
    name: str = "score",
) -> DataFrame:
    """The rows with a score from 0 to 1 of each whole text; a null text counts as empty.

    Labels, languages, sources and ids are not read. Repeated rows are scored alike; an empty
    table gives an empty result. A column of that name is replaced.
    """
    entries, weights = (model.lexicon.terms, model.lexicon.stems), model.weights

    def make():
        own = Model(Lexicon(*entries), weights)
        read = Reader(own.lexicon)

        def score(texts: list[str | None]) -> dict[str, pa.Array]:
            features = np.array([read.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
            return {name: pa.array(own.scores(features), type=pa.float64())}

        return score

    kept = [n for n in (docs.columns if keep is None else keep) if n.lower() != name.lower()]
    return add_columns(docs, text, f"{name} double", make, keep=kept)
