"""Syncs of landed documents into an account's store, in batch and as a stream."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens import schemas
from ledgerlens.operators import lookups, tables, validate
from ledgerlens.operators.store import Snapshots
from ledgerlens.scratch import scope, written


@dataclass(frozen=True)
class Merged:
    """What a merge has done: taken documents and lines, and the refused documents with their reasons."""

    documents: int
    lines: int
    refused: DataFrame


def _latest(dated: DataFrame) -> DataFrame:
    """The latest version of each document; whole rows are dealt by id only where an id comes more than once."""
    again = written(dated.groupBy(F.col("id").alias("_again")).count().where("count > 1").select("_again"))
    if again.isEmpty():
        return dated
    same = F.col("id").eqNullSafe(F.col("_again"))
    return written(dated.join(again, same, "left_anti").unionByName(tables.latest(dated.join(again, same, "left_semi"), "id", "seconds")))


def merge(store: Snapshots, landed: DataFrame, account: str = "main", now: int | None = None, full: bool = False, lasting_rows: bool = False) -> Merged:
    """Takes landed documents into the store, and advances its state.

    Of each document the latest version counts, and it replaces a stored one unless that is newer, with all its
    lines, so a batch that is run again changes nothing but the state.  Documents that the source no longer lists stay.
    Of two merges at once one is second and merges with what the first has stored.  The landed rows are written once, as they
    are read more than once, unless they come from a table that lasts (`lasting_rows`).
    """
    moment = int(time.time()) if now is None else now
    with scope(store.spark) as lasting:
        marked = landed.withColumn("reason", validate.document_reason())
        marked = marked if lasting_rows else written(marked)
        valid, refused = marked.where("reason is null").drop("reason"), lasting(marked.where("reason is not null"))
        last = _latest(valid.withColumn("seconds", validate.seconds_of(F.col("modified"))))
        headers = validate.normalise_documents(last.withColumn("n_lines", validate.line_count()), "n_lines")

        def state(before: dict | None, taken: tuple[int, int], stored: tuple[int, int]) -> dict:
            # a full sync counts what it took, another one what the tables hold
            whole = full or before is None
            counts = taken if whole else stored
            return {"lastSync": moment, "lastFullSync": moment if whole else before["lastFullSync"], "documentCount": counts[0], "itemDocumentCount": counts[1], "accountName": account, "schemaVersion": 1}

        taken = store.upsert(headers, validate.flatten_lines(last), state)
    return Merged(*taken, refused)


def remove_unlisted(store: Snapshots, listed: DataFrame) -> int:
    """Removes the documents that a full listing (column id) no longer has, with their lines; how many there were."""
    with scope(store.spark):
        held = store.read()
        if held is None:
            return 0
        gone = written(held[0].select("doc_id").join(listed.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"))
        if gone.isEmpty():
            return 0
        return store.remove(gone, lambda before, stored: before and before | {"documentCount": stored[0], "itemDocumentCount": stored[1]})


def kind_of(state: dict | None, account: str, forced: bool = False) -> str:
    """full for the first sync, for a store of another account and on demand, else delta."""
    return "full" if forced or state is None or state["accountName"] != account else "delta"


def needs_sync(state: dict | None, account: str, now: int, threshold: int = 3600, forced: bool = False) -> bool:
    """Whether a report has to sync first: on demand, before the first sync, for another account, or if the last sync is longer ago than the threshold."""
    return kind_of(state, account, forced) == "full" or state["lastSync"] < now - threshold


def sync(store: Snapshots, landed: DataFrame, account: str, now: int, forced: bool = False, removals: bool = False, lasting_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """A full or delta sync, as the store's state asks for: its summary row and the refused documents.

    A delta sync takes the documents modified after the last sync.  With `removals` the documents that the landed listing,
    which must then be a whole one, no longer has are removed; else they stay.  `lasting_rows` as in `merge`.
    """
    began = time.monotonic()
    state = store.state()
    kind = kind_of(state, account, forced)
    whole = landed
    if kind == "delta":
        recent = lookups.changed_since(landed.withColumn("_at", validate.seconds_of(F.col("modified"))), state["lastSync"], "_at")
        landed = recent.drop("_at")
    done = merge(store, landed, account, now, kind == "full", lasting_rows)
    deleted = remove_unlisted(store, whole) if removals else 0
    row = (kind, done.documents, done.lines, deleted, time.monotonic() - began)
    return store.spark.createDataFrame([row], "type string, documents_processed long, lines_processed long, documents_deleted int, seconds double"), done.refused


def ingest(spark: SparkSession, landing: str, store: Snapshots, checkpoint: str, quarantine: str, account: str = "main") -> StreamingQuery:
    """Starts a stream that takes all pages now in `landing` into the store and then ends; refused documents go to `quarantine`.

    The stream's checkpoint says which pages were taken; the store's state is advanced with every batch.
    """
    pages = spark.readStream.schema(schemas.DOCUMENT_PAGE).json(landing)
    documents = pages.select(F.explode(F.flatten("documents")).alias("row")).select("row.*")

    def batch(landed: DataFrame, number: int) -> None:
        merge(store, landed, account).refused.write.mode("overwrite").json(f"{quarantine}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
