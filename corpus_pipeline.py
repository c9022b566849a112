"""The corpus pipeline: quality, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; the
first three drop rows, the fourth removes words, the last turns documents into packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themelift.llm import boosted_trees, simhash, substring, toxicity
from themelift.llm.common import read_table
from themelift.llm.packing import pack_documents
from themelift.llm.queries import vocabulary_path
from themelift.sizing import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, all columns as they are.

    A null or empty text is scored like any other, by measurements of 0; equal texts have equal
    scores, so repeated rows stay or go together. Rows of a null id are never learned from. Without
    labels, or with labels of one kind, every row has the same score.
    """
    return boosted_trees.accepted(docs, read_table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models do not reject, all columns as they are.

    A null or empty text has no grams and the score of the prior. Repeated rows stay or go together;
    rows of a null id are never learned from.
    """
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, all columns as they are.

    Texts without words have fingerprint zero and are copies of each other and of what is within the
    bit distance of it. Rows of a null id stay. Of rows with one id in one component the first by
    fingerprint and hashes of the row stays; rows with one id in several components are judged apart.
    """
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has; every row stays.

    A text that loses nothing is as it was, white space included; otherwise its words that stay are
    joined by one space, and n_chars counts them. A null text stays null. Rows of equal id never
    remove words from each other; null ids stand after all others.
    """
    return substring.without_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: every document with its final id, in one piece or several.

    A null or empty text is the final id alone. Repeated rows are packed each; a null id stays null.
    Columns other than the id and the text are not carried.
    """
    return pack_documents(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", passages),
    ("packing", packing),
]

ORACLE_SQL = None  # hashes, learned scores and token ids have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
