"""Registered queries of the numbered operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlake.llm import (alignment, bpe, decontam, filter_audit, langid, licenses, lines, records, secrets, simhash,
                           token_counts, topk, url_filter)

PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_token_counts(spark, sf):
    return token_counts.count_tokens(_docs(spark, sf), public_tokenizers.path(PIECES))


def op2_decontamination(spark, sf):
    return decontam.find_items(_docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op3_language_id(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text", "lang")
    held = (langid.fold(F.col("doc_id")) == 0).alias("held_out")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 0))
    return langid.predict(docs, model).select("doc_id", held, "lang_pred", "score")


def op4_simhash_dedup(spark, sf):
    return simhash.near_duplicates(_docs(spark, sf), shingle=3, max_bits=2)


def op5_line_dedup(spark, sf):
    return lines.line_digest(lines.dedup_lines(_docs(spark, sf).select("doc_id", "text")))


def op6_token_records(spark, sf):
    out = records.written(_docs(spark, sf), public_tokenizers.path(BYTE_BPE))
    return records.record_digest(spark, out)


def op7_license_scan(spark, sf):
    return licenses.scan(_docs(spark, sf))


def op8_byte_bpe(spark, sf):
    path = public_tokenizers.path(BYTE_RANKS)
    encoded = bpe.encode(_docs(spark, sf), path, public_tokenizers.PATTERN)
    return bpe.round_trip_digest(bpe.decode(encoded, path, public_tokenizers.PATTERN))


def op9_secret_scan(spark, sf):
    return secrets.secret_digest(secrets.find_secrets(_docs(spark, sf)))


def op10_exact_top_k(spark, sf):
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op11_filter_audit(spark, sf):
    return filter_audit.audit(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op12_url_filter(spark, sf):
    return url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES)


def op13_tokenizer_alignment(spark, sf):
    return alignment.align(_docs(spark, sf), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


LLM_QUERIES = {name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)}

LLM_ORACLE = {
    "op10_exact_top_k": """
WITH fine AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_no AS query_no, a.vec_id AS query_id, b.vec_id, b.row_no, CAST(list_dot_product(
    CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.row_no <> b.row_no AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, vec_id, row_no) AS INTEGER) AS rank FROM scored
) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_filter_audit": filter_audit.audit_sql(),
    "op12_url_filter": url_filter.judge_sql(URL_RULES),
    "op7_license_scan": licenses.scan_sql(),
}
