"""The registered queries of this folder, and SQL where it can express one.

Each takes a whole table and the production parameters of its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, embed_dedup, licenses, resample, sharding, simhash, substring_dedup, token_counts, toxicity
from tidemark.llm.runtime import table

TOKENIZER = "byte_bpe_50k.json"


def fold(id_column: str) -> Column:
    """crc32 of the id as text, mod 3; rows with remainder 1 are held out."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("id") != 1)
    scored = toxicity.score(docs, model)
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"), "rejected")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "first_byte", "end_byte", "n_words", "n_chunks", "kept_doc_ids")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id))::BIGINT AS component_id,
  v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = v.vec_id
LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) m ON m.x = v.vec_id"""

_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k + 1 : k + least(len(w), 13)], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
o AS (
  SELECT doc_id, k, m, array_to_string(w[k + 1 : k + m], ' ') AS phrase
  FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS k FROM d, m WHERE len(w) >= m)),
f AS (SELECT o.doc_id, o.k, o.m, p.item_id FROM o JOIN p ON o.phrase = p.phrase AND o.m = p.m),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, 'null') AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_license_scan": op6_license_scan,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
}

#: Training, sampling, tokenizing, chunking and trees are not SQL; tests/llm holds each of them against a plain version: the
#: scorer, the chunk join, the whole draw, the tree over lists, the tokenizer's library, all pairs of fingerprints.
ORACLE_SQL = {
    "op2_embedding_near_dedup": _OP2_SQL,
    "op4_decontamination": _OP4_SQL,
    "op6_license_scan": licenses.scan_sql(),
}
