"""From raw documents to packed training sequences, one Spark stage after another.

Every stage but the last returns the columns of documents, whatever more of them there are and whatever they are called.
Nulls: a null text counts as empty and is packed as its end token; null doc_ids and sources are values of their own. Of
repeated rows one stays after exact dedup, as of all equal texts; ties go by file and row. An empty table gives an empty
table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, mixing, packing, simhash, toxicity
from siltstone.llm.storage import Scope, scope, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the classifier learns from the labelled documents of the stage's input."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs, mixing.Mix())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, packing.Packing(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the compression distances, fingerprints and tokenizer of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written and read again before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        after = Scope(spark)  # the stage's table goes when the next stage's is written
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), into=after)
        if before:
            before.remove()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
