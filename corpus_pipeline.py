"""From raw documents to packed sequences: quality, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and reads it back as the next stage's documents. All stages but the last return the columns of documents. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import language, mixing, packing, quality, simhash
from brightloom.llm.queries import tokenizer
from brightloom.llm.shared import materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the discriminant, fitted on the labels of ``sf_dir``, reaches the threshold.

    A null text is scored as an empty one. Rows are judged one by one, so repeated rows stay or go together; other columns, whatever their names, stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to the rank-order profile of some language, which becomes their lang.

    Null and empty texts, texts without a letter and texts in no learned language go; ties of two profiles fall to the first by name.
    """
    return language.keep_known(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id; rows without an id go unless their group has no other.

    Null and empty texts are one group; of rows that tie by id one stays, the same on every run.
    """
    return simhash.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row with the whole text for each time it is taken whole, and a row for each run of words taken of it.

    Null and empty texts take nothing and go; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; a null or empty text is its end id alone, repeated ids and rows are packed each by itself."""
    return packing.packed_digest(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_low_quality),
    ("language ID", drop_unknown_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]
#: SQL can't express the learned stages or the tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
