"""Operators as pipeline stages: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm import line_dedup, mixing, packing, simhash, toxicity
from vitrine.llm.shared import fresh

#: Production parameters.
LIMIT = 1024
SHINGLE, MAX_BITS = 3, 3
#: A source mixes languages: a line on a thirtieth of the pages of a language that has a tenth of
#: its source is boilerplate, if 99 % sure. Two pages may be two states of one.
BOILERPLATE_RATIO, BOILERPLATE_PAGES, BOILERPLATE_SURE = 0.003, 3, 2.33
SEQUENCE, END = 2048, 1


def tokenizer(name: str) -> str:
    """Place of a tokenizer file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(data: Column) -> Column:
    return F.crc32(data).cast("long")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below the threshold; the model is fitted on those given."""
    (score,) = fresh(docs, "score")
    model = toxicity.fit(docs, labels)
    scored = toxicity.with_scores(docs, model, name=score)
    return scored.filter(F.col(score) < threshold).drop(score)


def clean_lines(docs: DataFrame) -> DataFrame:
    """The documents without boilerplate lines; n_chars is that of the text left."""
    counts = tuple(fresh(docs, "n_lines", "n_dropped"))
    cleaned = line_dedup.drop_common_lines(
        docs, "source", "text", BOILERPLATE_RATIO, BOILERPLATE_PAGES, counts, BOILERPLATE_SURE
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind))
    return cleaned.select(*[F.col(f"`{name}`") for name in docs.columns])


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that of the least id (see drop_near_duplicates)."""
    return simhash.drop_near_duplicates(docs, max_bits=MAX_BITS, size=SHINGLE)


def take_mix(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    columns = [F.col(f"`{n}`") for n in docs.columns]
    held = docs.select(F.struct(*columns).alias("doc"), "doc_id", "source", "text")
    mixed = mixing.mix(held, mixing.words(F.col("text")))
    return mixing.repeat(mixed).select("doc.*")


def pack_documents(docs: DataFrame, remember: int = packing.REMEMBER) -> DataFrame:
    """A row for each piece of each document: which tokens it holds, and where it lies."""
    cut = packing.pieces(docs, tokenizer("word_bpe_49k.json"), END, SEQUENCE, remember=remember)
    slim = cut.select("doc_id", "start", "length", crc(F.col("ids")).alias("ids_crc32"), "doc_tokens")
    return packing.pack(slim, ("doc_id", "start", "ids_crc32"), "length", SEQUENCE)
