"""The corpus pipeline: language, quality, near copies, personal data, packing.

``run`` applies ``STAGES`` to ``documents``. A stage gets what the one before it
kept, written as Parquet in the shared folder and read again, and its decisions
take effect: a rejected document is gone, a copy too, personal data is replaced.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import language, ngramjoin, packing, pii, quality
from helixframe.llm.common import load, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; profiles are learned from the documents given."""
    return language.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id."""
    return ngramjoin.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it generalised."""
    return pii.sanitise(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_copies", drop_near_copies),
    ("personal_data", remove_personal_data),
    ("packing", pack_documents),
]

#: Tokenizers and learned profiles are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
