"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import exact_dedup, language_id, minhash, mixing, packing
from linkloom.llm.common import materialise, table
from linkloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; what it rejects goes.

    Null text, text without a letter and text far from every learned language go; with no labelled row
    all go. Rows that repeat stay or go alike; long texts are judged whole; all columns are kept.
    """
    return language_id.keep_identified(docs, language_id.fit(docs.where(~language_id.held_out(docs["doc_id"]))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    Null text equals the empty text, a null id is the smallest; of rows equal in id and text one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) one document of each group, the smallest doc_id.

    Texts without words and rows without an id stay; rows with one doc_id stay or go together.
    """
    return minhash.drop_near_duplicates(docs, width=5, threshold_pct=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents left out, kept or repeated.

    A null source is a source of its own; rows equal in id and text are copies, of which as many are
    taken as the budget says; reruns agree.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document.

    Null text is the empty text, one piece with the end id; a null id is kept; rows that repeat are packed each.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]

#: The stages aren't expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
