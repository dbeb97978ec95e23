"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Every stage takes rows with nulls in any column, repeated rows, no rows at all
and further columns of any name; all but the last return the columns that came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genloom.llm import exact_dedup, packing, quality, secrets, simhash
from genloom.session import relieve, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go; rows that repeat stay or go
    together; a very long text is judged as a whole. Texts don't change.
    """
    relieve(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, runs of white space counted as one space, the smallest doc_id stays.

    Null counts as empty. Of rows that repeat an id and its text one stays;
    a null id stays only if no row of its text has an id.
    """
    relieve(spark)
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays: no two texts that stay are near, and each that goes is near one that stays.

    Near means a Jaccard similarity of 0.8 or more of the sets of five-word
    shingles. Rows are taken in order of a hash of id and text. Rows without
    an id, and texts without words, null ones among them, stay.
    """
    relieve(spark)
    return simhash.without_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every row stays, a null text stays null.

    ``n_chars`` follows the text where it changes.
    """
    relieve(spark)
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the documents in sequences of 2048, a row a piece.

    A null or empty text is the closing id alone; a text of over 2048 ids is
    cut into pieces; rows that repeat are packed each for itself.
    """
    relieve(spark)
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]

#: SQL cannot express the model of the quality stage; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
