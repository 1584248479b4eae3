"""From raw documents to packed training sequences.

Toxic documents go; of exact copies and of near-duplicate groups one document stays; sources are mixed to their
target weights; what is left is packed into sequences. Each stage works on everything its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import exact_dedup, mixing, packing, simhash, toxicity
from tracemill.llm.common import like_documents, prepare, read_table, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is more likely zero than not, by a model fitted on the labelled ones."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return like_documents(toxicity.without_toxic(docs, model), COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the one with the longest original, then the smallest id."""
    prepare(spark)
    return like_documents(exact_dedup.without_copies(docs), COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near-equal fingerprints the document with the smallest id."""
    prepare(spark)
    return like_documents(simhash.one_per_component(docs), COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document with two copies is two rows."""
    prepare(spark)
    return like_documents(mixing.mixed(docs), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; rows of repeated documents are packed each."""
    prepare(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the covering code or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows between two stages are a table in the shared scratch folder."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
