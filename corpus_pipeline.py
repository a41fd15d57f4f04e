"""The corpus pipeline: every stage takes all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import language, mixing, neardup, packing, substring
from helixframe.session import Scratch

#: A document whose best language holds less than this part of its trigrams is in none of the known languages.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or mostly of unknown trigrams, go.

    Null and empty texts have no letter and go. Long texts are judged whole. Ties
    of languages go to the first in code point order and don't matter here.
    Repeated rows stay or go together. An empty table gives none. Columns return as
    they are, whatever their names; a null doc_id, lang or source takes part.
    """
    return language.known(docs, LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: Jaccard similarity of 0.8 or more over five-word shingles.

    Pairs of SimHash fingerprints within 3 bits come from the covering tables of
    op5_neardup, those further apart from sketches; both are checked on the shingles. That of the smallest doc_id stays; a row without doc_id only where its whole
    group has none. Repeated rows are copies, one stays; of rows that share doc_id
    and text the least hash of their other columns decides. Null texts, empty ones
    and those without words are copies of each other. Texts are used whole. Rows of
    one doc_id with unlike texts all stay. An empty table gives none. Columns
    return as they are, whatever their names.
    """
    return neardup.deduplicate(docs, similarity=0.8, size=5, radius=3)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words and more that occur earlier; a document that was nothing else goes.

    Earlier is a smaller doc_id or the same text; rows without doc_id come last, in
    the order of their text's hash. Null and empty texts stay as they are. Texts
    are used whole. Rows that share a doc_id are one place, so repeated rows are
    cut alike and all stay. n_chars follows the text. An empty table gives none.
    Other columns return as they are, whatever their names.
    """
    return substring.strip(docs, length=20)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: copies of documents by source weight, in the order of training.

    A null source is one of its own, last. Null and empty texts have size 0 and are
    taken as their place says. Long texts count whole. Repeated rows each count.
    Copies of one training time are in the order of doc_id, null first. An empty
    table gives none. Columns return as they are, whatever their names.
    """
    return mixing.curriculum(docs, cycle=(1, 2, 3), epochs=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in sequences.

    A null or empty text is the one id 1. Long texts are cut into pieces, none is
    left out. Repeated rows are packed each for itself; a null doc_id stays null.
    Pieces of one length are alike, so ties don't matter. An empty table gives no
    rows. Other columns than doc_id and text are not read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express near-duplicate components or packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
