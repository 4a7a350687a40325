"""A corpus pipeline over `documents`: each stage is one operator of threadloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import language_id, line_dedup, mixing, near_duplicates, packing
from threadloom.llm.common import materialize, table
from threadloom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those for which no language is likelier than all others together."""
    return language_id.keep_identified(docs, least=0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; a document whose every line went has nothing left and goes too."""
    return line_dedup.keep_new_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: sets of five-word shingles with a Jaccard similarity of 0.8 or more. SimHash
    fingerprints in pigeonhole blocks with a Hamming check link what they can, each link verified; what they leave apart is joined on prefix shingles."""
    return near_duplicates.drop_similar(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them, in order of their training position."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language network and the tokenizer are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
