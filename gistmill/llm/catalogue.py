"""Queries of this package on the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import (
    decontaminate, embeddings, hard_negatives, html_text, licenses, mixing, packing, simhash, spelling, spotsigs, token_counts,
    token_files, toxicity,
)
from gistmill.llm.common import read_table, small_batches

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    pages = read_table(spark, folder, "pages").select("page_id", "url", html_text.main_text_column(F.col("html")).alias("text"))
    return pages.select("*", F.length("text").cast("bigint").alias("n_chars"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.embedding_links(read_table(spark, folder, "embeddings"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(read_table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, folder, "documents"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_labels(licenses.license_blocks(read_table(spark, folder, "documents")))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    model = toxicity.train(documents, read_table(spark, folder, "labels"))
    return toxicity.toxicity_scores(documents, model)


def op8_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_fingerprints(read_table(spark, folder, "documents"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id, weight``: 2 if labelled good, 1/2 if labelled poor."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    quality = quality_weights(read_table(spark, folder, "labels"))
    return mixing.mixture(read_table(spark, folder, "documents"), quality=quality)


_WEIGHTED = """(SELECT d.doc_id, d.source, d.text, CASE q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents d LEFT JOIN (SELECT doc_id AS i, max(quality) AS q FROM labels GROUP BY 1) ON i = d.doc_id)"""


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, folder, "embeddings").select(
        "vec_id", label.alias("label"), hard_negatives.integer_vector(F.col("embedding")).alias("vector")
    )
    return hard_negatives.hard_negatives(rows)


_INTEGERS = """(SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def op12_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_hits(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_files": op4_token_files,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_spotsigs": op8_spotsigs,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontaminate": op12_decontaminate,
    "op13_spelling": op13_spelling,
}

SQLS = {
    "op9_mixing": mixing.mixture_sql(_WEIGHTED, "weight"),
    "op11_hard_negatives": hard_negatives.hard_negatives_sql(_INTEGERS),
    "op12_decontaminate": decontaminate.benchmark_hits_sql(),
}
