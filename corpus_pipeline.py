"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. ``run`` writes every stage's
result as Parquet in the shared folder, reads it again as the next one's documents, and deletes what the stage before
it wrote.

Defined results: rows with a null or empty text leave with the first stage, as no language can be told; null sources and
null doc_ids are kept as such throughout (see each stage); an empty table gives an empty table; further columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, exact_dedup, jaccard_join, language_id, mixing, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay (operator 6), null, empty and letterless texts don't; repeated rows fare alike; without any label all go."""
    return language_id.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays (operator 8): the smallest doc_id, nulls last; of rows that share it the first by their columns; null texts all stay."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 7): the smallest doc_id; texts without a word and null doc_ids are in no group."""
    return jaccard_join.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, those of smaller sources repeated until the largest has been read (operator 2); a null source is one, and rows that share source and doc_id stay together."""
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes (operator 1); a document without a token goes nowhere."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The first stage applies a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(spark, begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
