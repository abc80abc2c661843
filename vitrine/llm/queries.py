"""The operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (
    alignment,
    licenses,
    line_dedup,
    manifest,
    mixing,
    neighbours,
    repeats,
    sharding,
    simhash,
    stages,
    token_counts,
    topk,
    toxicity,
)
from vitrine.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 16


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


# DuckDB has no crc32: byte by byte, by a table made of the polynomial.
SHARDS_SQL = f"""
WITH made AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: 1::UBIGINT)),
      lambda c, one: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)),
texts AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS digits FROM documents),
held AS (
  SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS size,
    CAST(xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(range(strlen(text)),
        lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
      lambda crc, byte: xor(crc >> 8, tab[CAST((xor(crc, byte) & 255) + 1 AS BIGINT)]))) AS BIGINT) AS text_crc32
  FROM texts, made),
mixed AS (
  SELECT *, md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(text_crc32 AS VARCHAR))) AS mix,
    CAST(CAST('0x' || substr(md5(concat_ws(':', '17', 'phase', coalesce(source, ''))), 1, 13) AS UBIGINT) AS DOUBLE)
      / pow(16, 13) AS phase
  FROM held),
shares AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY mix, doc_id NULLS FIRST, text_crc32) - 1 + phase)
    / count(*) OVER (PARTITION BY source) AS share FROM mixed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY share, mix, doc_id NULLS FIRST, text_crc32) - 1 AS place,
    count(*) OVER () AS total FROM shares)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INTEGER) AS shard,
  CAST(place - (place * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


@query("op1_interleaved_shards", SHARDS_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        stages.crc(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    shards = sharding.interleave(rows, SHARDS, "source", ("doc_id", "text_crc32"))
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_prefix_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    path = stages.tokenizer("byte_bpe_50k.json")
    counted = token_counts.prefix_counts(docs, path, keep=("doc_id", "n_bytes"))
    n_tokens = token_counts.tokens_in(F.col("prefix_tokens"))
    return counted.select(
        "doc_id",
        "n_bytes",
        n_tokens.alias("n_tokens"),
        (n_tokens > stages.LIMIT).alias("over_limit"),
        token_counts.tokens_in(F.col("prefix_tokens"), F.lit(1000)).alias("tokens_in_1000_chars"),
    )


@query("op3_hash_prefix_forest")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbours(table(spark, folder, "embeddings").select("vec_id", "embedding"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws(':', '29', coalesce(CAST(doc_id AS VARCHAR), ''))) AS mix
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
    WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
filled AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST) AS nth,
    1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM weighted
  WINDOW before AS (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT arg_min(rest / weights, nth)
    FILTER (WHERE weight * (rest / weights) <= 2 * source_size) AS level
  FROM filled),
targets AS (
  SELECT source, source_size,
    CASE WHEN level IS NULL THEN 2.0::DOUBLE * source_size
      ELSE least(weight * level, 2.0::DOUBLE * source_size) END AS target
  FROM weighted, levels),
placed AS (
  SELECT s.*, t.source_size, t.target,
    sum(size) OVER (PARTITION BY s.source ORDER BY mix, s.doc_id NULLS FIRST, size
                    ROWS UNBOUNDED PRECEDING) - size AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN source_size > 0 AND whole < 2
    AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


@query("op4_capped_mixing", MIX_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    slim = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("words"))
    mixed = mixing.mix(slim, F.col("words"))
    taken = (F.col("size") * F.col("repetitions")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


@query("op5_lexicon_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.with_scores(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op6_first_fit_decreasing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return stages.pack_documents(docs, remember=1_000_000)


@query("op7_license_signatures")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    base, kept = F.col("base"), F.col("detections")
    held = F.size(base) > 0
    join = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.when(held, F.array_min(base["start"])).cast("long").alias("first_word"),
        F.when(held, F.array_max(base["start"])).cast("long").alias("last_word"),
        join(base["label"]).alias("base_labels"),
        join(F.concat(base["label"], kept["label"])).alias("labels"),
        F.coalesce(F.array_max(kept["trust"]), F.when(held, 0.9), F.lit(0.0)).alias("score"),
    )


TOP_SQL = """
WITH held AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS whole FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.whole, b.whole) AS BIGINT) AS score
  FROM held a JOIN held b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM scored)
WHERE nth <= 5
"""


@query("op8_branch_and_bound", TOP_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def _lines_sql(source: str, keep: str) -> str:
    """Rows (keep, site, text) without the lines common on their site."""
    return f"""
WITH page AS ({source}),
lines AS (
  SELECT DISTINCT site, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line
  FROM page WHERE text IS NOT NULL),
totals AS (
  SELECT site, {stages.BOILERPLATE_RATIO}::DOUBLE * count(DISTINCT text) AS expected
  FROM page WHERE text IS NOT NULL GROUP BY site),
counted AS (SELECT site, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY site, line),
common AS (
  SELECT c.site, list(c.line) AS lines FROM counted c
  JOIN totals t ON c.site IS NOT DISTINCT FROM t.site
  WHERE n >= {stages.BOILERPLATE_PAGES} AND n > expected + {stages.BOILERPLATE_SURE}::DOUBLE * sqrt(expected)
  GROUP BY c.site),
joined AS (
  SELECT p.*, string_split(p.text, chr(10)) AS whole,
    list_filter(string_split(p.text, chr(10)),
      lambda x: c.lines IS NULL OR NOT list_contains(c.lines, trim(x))) AS kept
  FROM page p LEFT JOIN common c ON p.site IS NOT DISTINCT FROM c.site)
SELECT {keep}, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(whole) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(whole) - len(kept) END AS BIGINT) AS n_dropped
FROM joined
"""


LINES_SQL = _lines_sql("SELECT doc_id, source AS site, text FROM documents", "doc_id")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PAGES_SQL = _lines_sql(
    f"SELECT page_id, lower(regexp_extract(url, '{_HOST}', 1)) AS site, html AS text FROM pages", "page_id, site"
)


def _clean(docs: DataFrame, site: str) -> DataFrame:
    return line_dedup.drop_common_lines(
        docs, site, "text", stages.BOILERPLATE_RATIO, stages.BOILERPLATE_PAGES, sure=stages.BOILERPLATE_SURE
    )


@query("op9_site_line_dedup", LINES_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return _clean(docs, "source").select("doc_id", "text", "n_lines", "n_dropped")


@query("page_lines_by_host", PAGES_SQL)
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same on raw pages, whose site is the host of their address."""
    host = F.lower(F.regexp_extract("url", _HOST, 1)).alias("site")
    pages = table(spark, folder, "pages").select("page_id", host, F.col("html").alias("text"))
    return _clean(pages, "site").select("page_id", "site", "text", "n_lines", "n_dropped")


@query("op10_simhash_anchors")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, stages.MAX_BITS, stages.SHINGLE)
    digits = F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


@query("op11_sorted_suffixes")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = repeats.removed_passages(docs, 50, kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(text: str) -> str:
    values = [f"CAST({text if name == 'text' else name} AS VARCHAR)" for name in _FIELDS]
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


# DuckDB has no crc32: the polynomial, bit by bit, over the digits of the id.
_CRC_SQL = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: ascii(c)::UBIGINT)), lambda crc, byte: list_reduce(
        [xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1],
        lambda x, one: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes of the trees of (tree, place, hash), level by level; runs of three with their hashes."""
    return f"""{name}(lvl, tree, place, hash, n) AS (
  SELECT 0, tree, place, hash, count(*) OVER (PARTITION BY tree) FROM {leaves}
  UNION ALL
  SELECT lvl + 1, tree, place // 3, sha256(string_agg(hash, '' ORDER BY place)), any_value((n + 2) // 3)
  FROM {name} WHERE n > 1 GROUP BY lvl, tree, place // 3),
{name}_runs AS (
  SELECT lvl, tree, place // 3 AS run, list(hash ORDER BY place) AS hashes FROM {name}
  WHERE n > 1 GROUP BY lvl, tree, place // 3)"""


def _steps_sql(nodes: str, leaves: str) -> str:
    """(key, lvl, before, after): a leaf's siblings at each level of its tree."""
    return f"""SELECT key, lvl, array_to_string(list_slice(hashes, 1, spot), '') AS before,
    array_to_string(list_slice(hashes, spot + 2, 3), '') AS after
  FROM (SELECT l.key, r.lvl, r.hashes, (l.place // CAST(pow(3, r.lvl) AS BIGINT)) % 3 AS spot
    FROM {leaves} l JOIN {nodes}_runs r ON l.tree IS NOT DISTINCT FROM r.tree
      AND l.place // CAST(pow(3, r.lvl + 1) AS BIGINT) = r.run)"""


MANIFEST_SQL = f"""
WITH RECURSIVE base AS (
  SELECT *, {_leaf_sql('text')} AS leaf,
    CASE WHEN ({_CRC_SQL}) & 1 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")}
      ELSE {_leaf_sql('text')} END AS other
  FROM documents),
leaves AS (
  SELECT row_number() OVER () AS key, doc_id, leaf AS hash, other, source AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM base),
{_tree_sql('nodes', 'leaves')},
tops AS (
  SELECT 0 AS tree, tree AS key, hash,
    row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
{_tree_sql('above', 'tops')},
own_steps AS ({_steps_sql('nodes', 'leaves')}),
top_steps AS ({_steps_sql('above', 'tops')}),
steps AS (
  SELECT key, before, after, row_number() OVER (PARTITION BY key ORDER BY lvl) AS nth FROM (
    SELECT * FROM own_steps UNION ALL
    SELECT l.key, 100 + s.lvl, s.before, s.after FROM leaves l
    JOIN top_steps s ON l.tree IS NOT DISTINCT FROM s.key)),
folded(key, nth, hash) AS (
  SELECT key, 0, other FROM leaves UNION ALL
  SELECT f.key, s.nth, sha256(before || f.hash || after) FROM folded f
  JOIN steps s ON f.key = s.key AND s.nth = f.nth + 1),
proofs AS (SELECT key, sha256(string_agg(before || after, '' ORDER BY nth)) AS proof FROM steps GROUP BY key)
SELECT l.doc_id, l.hash AS leaf, t.hash AS subroot, r.hash AS root,
  coalesce(p.proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = r.hash AS verified
FROM leaves l JOIN tops t ON l.tree IS NOT DISTINCT FROM t.key
JOIN (SELECT hash FROM above WHERE n = 1) r ON true
JOIN (SELECT key, arg_max(hash, nth) AS hash FROM folded GROUP BY key) f ON l.key = f.key
LEFT JOIN proofs p ON l.key = p.key
"""


@query("op12_merkle_manifest", MANIFEST_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*_FIELDS)
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = manifest.manifest(docs, list(_FIELDS), "source", "doc_id", {"text": tampered})
    folded = manifest.fold(F.col("changed_leaf"), F.col("way"))
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        manifest.digest(manifest.siblings(F.col("way"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_aligned_tokens")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    one, two = stages.tokenizer("byte_bpe_50k.json"), stages.tokenizer("piece_bpe_32k.model")
    return alignment.alignment(
        docs, lambda: alignment.byte_level(one), lambda: alignment.sentence_pieces(two)
    )
