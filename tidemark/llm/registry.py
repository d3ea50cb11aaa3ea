"""Queries of the training-data operators: thin wrappers that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, conversations, language, line_rules, media, mixing, phrases, quality, simhash, token_counts, token_files, topk, toxicity
from tidemark.llm import textbatch as tb


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", token_counts.sampled_edits())
    return token_counts.count_with_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def kept_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are kept, two logs of edits (each for some of the documents) change them, and they are counted."""
    ranks, docs = public_tokenizers.path("byte_bpe_50k.tiktoken"), _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tb.shared_dir(spark, "trees")
    token_counts.keep_trees(token_counts.plant(docs, ranks, public_tokenizers.PATTERN), out, max(1, docs.count() // token_counts.TREES_A_BUCKET))
    edits = docs.withColumn("edits", token_counts.sampled_edits()).select("doc_id", F.posexplode("edits").alias("seq", "e")).select("doc_id", "seq", "e.*")
    version = 0
    for part in (0, 1):
        version = token_counts.tend_kept(spark, out, edits.where(F.col("doc_id") % 7 == part), version, ranks, public_tokenizers.PATTERN)
    return token_counts.tree_counts(spark.read.parquet(out))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", tb.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", tb.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tb.shared_dir(spark, "token-shards")
    token_files.write_token_shards(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_shards(spark.read.parquet(out))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_rules.judge(docs, line_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, room=byte_bpe.ROOMY)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_table(spark, sf_dir, "documents"), tb.shared_dir(spark, "media"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.page_items(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"), tb.shared_dir(spark, "page-media"))
    return found.select("page_id", "pos", "kind", "ref", "caption", "digest", F.length("text").alias("n_chars"), "n_bytes", "media_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", tb.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=100, most_words=5, top=2000)


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, list_slice(w, i, i + k - 1) AS parts
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words) CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, any_value(parts) AS parts, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
inner_parts AS (
  SELECT g.lang, array_to_string(list_slice(g.parts, i, i + j - 1), ' ') AS phrase, g.f
  FROM f g, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS j) WHERE j < g.k AND i + j - 1 <= g.k),
kept AS (
  SELECT f.* FROM f LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY ALL) m USING (lang, phrase)
  WHERE k >= 2 AND (most IS NULL OR 100 * most < 100 * f.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM kept c CROSS JOIN (SELECT unnest(range(1, 5)) AS cut)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.parts, 1, cut), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.parts, cut + 1, c.k), ' ')
  JOIN totals t ON t.lang = c.lang WHERE cut < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


EXACT_TOPK_SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.row_id <> c.row_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_quality_classifier, op3_language_id, op4_source_mixing, op5_token_files, op6_quality_rules, op7_byte_bpe, op8_media_columns, op9_toxicity, op10_simhash_neardup, op11_phrase_collocations, op12_exact_topk, op13_conversation_repair, page_sequences, kept_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of the others none is expressible in SQL as a whole (trained models, tokenizers, iterations,
    XXH64, CRC-32): tests/llm compares them with brute force, round trips and held-out labels."""
    return {"op11_phrase_collocations": PHRASES_SQL, "op12_exact_topk": EXACT_TOPK_SQL}
