"""The corpus pipeline: toxic documents go, of near copies one stays, repeated passages are cut, sources are mixed, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossweave.llm._common import stored, table
from glossweave.llm.mixing import mix_sources
from glossweave.llm.packing import packed_windows
from glossweave.llm.simhash import drop_near_duplicates
from glossweave.llm.substrings import drop_repeated_passages
from glossweave.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the factorization machine, fitted on ``labels``, doesn't reject.

    Null and empty texts, and rows without an id, stay; repeated rows share their fate; long texts are judged whole.
    Without labels of both kinds all rows stay. No rows in, no rows out.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least doc_id.

    Repeated rows are copies, so one of them stays; a null doc_id comes after all others; null texts and those without a
    word have no copies and stay. No rows in, no rows out.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without passages of 50 words or more that occur earlier in the corpus; n_chars follows.

    Occurrences are ordered by a hash of the text, then by doc_id (null last). Rows of which nothing is left go; null,
    empty and short texts stay as they were. No rows in, no rows out.
    """
    return drop_repeated_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, a row as often as it has copies.

    A null source is one by itself; null and empty texts are rows like others, of length 1 where n_chars is null; ties go
    by doc_id. No rows in, no rows out.
    """
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens with the texts of the documents in them: the training sequences.

    Null texts have no tokens and end here; an empty text is the one token that ends it; repeated rows, that mixing asked
    for, are packed each by itself; long texts fill several windows. No rows in, no windows out.
    """
    return packed_windows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no factorization machine, nor SimHash, nor packing; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; an empty table gives no windows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
