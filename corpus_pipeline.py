"""Documents to packed training sequences: toxicity, near-duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import mixing, packing, simhash, toxicity
from gistmill.llm.catalogue import WORD_BPE, quality_weights
from gistmill.llm.common import read_table, small_batches
from gistmill.session import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Null and empty texts are scored like any other; repeated rows are kept or go together.
    """
    small_batches(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_column(model, F.col("text")) < toxicity.THRESHOLD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash of four-word shingles within four bits.

    Null and blank texts are one group; the smallest id stays, null ids last, and of rows that
    repeat an id one.
    """
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, weighed by their quality labels.

    A null source is a source of its own; empty texts cost nothing and come as often as their
    place in the order says, three times at most.
    """
    return mixing.mixed_documents(docs, quality=quality_weights(read_table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; a null or empty text is a piece of its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-copies", one_of_near_copies),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained dictionaries, iterated components and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
