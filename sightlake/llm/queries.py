"""Registered queries of the operators, with production parameters over whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, byte_bpe, chat, decontaminate, exact_dedup, language_id, lm_score, packing, simhash, token_counts, token_files, warc, whitening
from .common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op7_exact_dedup", sql=r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_documents(table(spark, sf_dir, "documents"))


@query("op3_warc", sql="""
WITH bytes AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM bytes),
digits AS (
  SELECT page_id, i, (CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS v
  FROM hashed, range(0, 32) AS r(i)),
digests AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INT), 1), '' ORDER BY i) AS payload_digest FROM digits GROUP BY page_id),
kept AS (SELECT hex, max(page_id) AS keeper FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM hashed JOIN digests USING (page_id) JOIN kept USING (hex)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


@query("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.corpus_scores(table(spark, sf_dir, "documents"))


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_chat_rotation", sql=r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
lines AS (
  SELECT t.*, perspective, speaker = perspective AS own,
    '<|turn|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      ELSE 'user name=' || regexp_replace(speaker, '\W', '_', 'g') END || chr(10) AS head, said || '<|end|>' AS body
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head || body) + 1) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, said ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS start
  FROM lines)
SELECT conv_id, perspective, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, speaker, said) AS rendered,
  coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY turn NULLS LAST, speaker, said) FILTER (WHERE own), '') AS mask,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS trained_chars
FROM placed GROUP BY conv_id, perspective
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotation_report(table(spark, sf_dir, "conversations"))


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
