"""A corpus pipeline: toxic documents go, exact and near copies go, and what is left is packed into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import exact, nearcopies, packing, queries, toxicity
from ledgerlens.scratch import scope


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity classifier doesn't reject; a null text counts as empty and copies fare alike."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of those with equal texts.

    Null texts count as empty; rows without an id come last; rows that repeat both id and text go down to one.
    """
    return exact.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates.

    Texts without words are near duplicates of each other; ids and repeats as in the stage before.
    """
    return nearcopies.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of all documents in windows: rows of pieces with their ids, sequence_id and offset.

    A null text is packed as its end token; documents that repeat are packed each.
    """
    return packing.pack(queries.pieces_of(docs), queries.WINDOW, order=("doc_id", "start", "ids_crc32"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", packed)]

#: None: the classifier, the fingerprints and the packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written and read again as the next one's input.

    No documents give no rows.  Columns of `documents` may have any names; those of the stages' own are chosen apart.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark) as lasting:  # in which the stages' results stand but for the last
        for number, (_, stage) in enumerate(STAGES, 1):
            with scope(spark) as within:  # whatever a stage writes on its way
                docs = (lasting if number == len(STAGES) else within)(stage(spark, docs, sf_dir))
    return docs
