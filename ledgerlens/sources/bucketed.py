"""Headers and lines as bucketed tables: joins by document need no shuffle, however often they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def buckets_for(documents: int, held: int = 250_000) -> int:
    """Buckets of about `held` documents each, so that what one task sorts does not grow with the tables."""
    return max(8, -(-documents // held))


def save(documents: DataFrame, lines: DataFrame, name: str, buckets: int, place: str | None = None) -> None:
    """Writes both tables to the session's catalogue as <name>_documents and <name>_lines, in as many buckets by document.

    Tables of these names are replaced.  A bucket should hold what one task can sort, some 100 MB.  The files go to the folder
    `place`, or else to the warehouse.
    """
    for table, rows in (("documents", documents), ("lines", lines)):
        # dealt as the buckets are, so that each task writes one file
        dealt = rows.repartition(buckets, "doc_id")
        writer = dealt.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id")
        (writer.option("path", f"{place}/{table}") if place else writer).saveAsTable(f"{name}_{table}")


def read(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Headers and lines as they were saved."""
    return spark.table(f"{name}_documents"), spark.table(f"{name}_lines")
