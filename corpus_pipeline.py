"""The document pipeline: quality rules, toxicity, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last keep the columns of documents, whatever they are called; a rejected
document is left out with all its rows. Null texts and texts of few words go in the first stage; an empty table stays
empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm import decontaminate, packing, quality, simhash, toxicity
from logtriage.llm.common import free_name, stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep (operator 6); trusted texts are told by labels.quality."""
    name = free_name(docs, "_quality")
    found = quality.quality_rules(docs, table(spark, sf_dir, "labels"), name=name)
    return found.where(F.col(name)["kept"]).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold (operator 8), learned from labels.toxic."""
    name = free_name(docs, "_toxicity")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), name)
    return found.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints (operator 3: 4-word shingles, 4 bits), the one with the smallest doc_id."""
    return simhash.keep_one(docs, words=4, radius=4)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages (operator 10)."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in as few sequences as possible (operator 7)."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("best-fit packing", pack_sequences),
]
# Learned weights, fingerprints and tokenizers have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
