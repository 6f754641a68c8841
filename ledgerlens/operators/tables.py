"""Maintenance of stored tables: upserts, replacements, deletions, change feeds and sync state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import validate
from ledgerlens.schemas import STATE


def latest(rows: DataFrame, key: str, order: str = "modified") -> DataFrame:
    """One row for each key: the one with the largest `order`, then the largest of all its fields."""
    last = F.max(F.struct(F.col(order).alias("_order"), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(F.col(key).alias("_key")).agg(last.alias("last")).select("last.row.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "doc_id", order: str = "modified") -> DataFrame:
    """`existing` with the latest incoming row of each key in place of its own, unless its own is newer."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(latest(incoming, key, order).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*existing.columns), F.struct(order, "_new"))
    return both.groupBy(F.col(key).alias("_key")).agg(last.alias("row")).select("row.*")


def lines_of(lines: DataFrame, documents: DataFrame, dealt_by: str | None = None, others: bool = False) -> DataFrame:
    """The lines of these documents, or all others.

    `dealt_by` names a column of both tables of which each document has one value, and by which the lines are dealt already: they
    meet the documents by it, and are not dealt by document as well.
    """
    how = "left_anti" if others else "left_semi"
    if dealt_by is None:
        return lines.join(documents.select("doc_id"), "doc_id", how)
    ids = documents.where("doc_id is not null").groupBy(F.col(dealt_by).alias("_dealt")).agg(F.collect_set("doc_id").alias("_ids"))
    return lines.join(ids, (F.col(dealt_by) == F.col("_dealt")) & F.array_contains("_ids", F.col("doc_id")), how)


def replace_lines(lines: DataFrame, new_lines: DataFrame, documents: DataFrame, dealt_by: str | None = None) -> DataFrame:
    """`lines` in which the lines of these documents are replaced by the new ones; `dealt_by` as in `lines_of`."""
    return lines_of(lines, documents, dealt_by, others=True).unionByName(new_lines.select(*lines.columns))


def append_lines(lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    return lines.unionByName(new_lines.select(*lines.columns))


def delete_documents(documents: DataFrame, lines: DataFrame, ids: DataFrame, dealt_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without these documents; `dealt_by` as in `lines_of`."""
    return documents.join(ids.select("doc_id"), "doc_id", "left_anti"), lines_of(lines, ids, dealt_by, others=True)


def delete_lines(lines: DataFrame, ids: DataFrame, dealt_by: str | None = None) -> DataFrame:
    return lines_of(lines, ids, dealt_by, others=True)


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """`rows` after a change feed: columns op (create, update, delete), seq, and those of `rows`.

    Of each key the changes after its last deletion apply, field by field the latest one that is given; an update
    leaves other fields as they are, and an update of an unknown key is ignored.
    """
    fields = [c for c in rows.columns if c != key]
    seen = changes.withColumn("_cut", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(key)))
    live = seen.where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    given = live.groupBy(key).agg(F.max(F.col("op") == "create").alias("_created"), *[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in fields])
    gone = changes.where("op = 'delete'").select(key).distinct()
    kept = rows.join(gone, key, "left_anti").withColumn("_known", F.lit(True))
    both = kept.join(given, key, "full").where("_known or _created")
    return both.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields]).select(*rows.columns)


def split_creates(changes: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Changes without the creates that `reason` refuses, and those with their reason."""
    marked = changes.withColumn("reason", F.when(F.col("op") == "create", reason))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def apply_customer_feed(customers: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers after a change feed, and the refused creates."""
    valid, refused = split_creates(changes, validate.context_reason(F.col("context_id"), accounts=True))
    return apply_changes(customers, valid), refused


def apply_document_feed(documents: DataFrame, lines: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers and lines after a change feed whose records nest their lines as landed documents do, and the refused creates.

    Lines that a change gives replace all of the document's; a deletion takes the lines along.
    """
    valid, refused = split_creates(changes, validate.document_reason())
    kept = [c for c in documents.columns if c != "doc_id"]
    given = valid.withColumns({"doc_number": F.col("document_number"), "issue_date": validate.day_of(F.col("issue_date")), "modified": validate.seconds_of(F.col("modified"))}).select("op", "seq", "id", *kept, "document_items")
    held = documents.withColumnRenamed("doc_id", "id").withColumn("document_items", F.lit(None).cast(given.schema["document_items"].dataType))
    after = apply_changes(held, given)
    renewed = after.where("document_items is not null")
    gone = given.where("op = 'delete'").select(F.col("id").alias("doc_id")).unionByName(renewed.select(F.col("id").alias("doc_id")))
    left = lines.join(gone, "doc_id", "left_anti")
    new = validate.flatten_lines(renewed).withColumn("item_id", F.col("item_id").cast(lines.schema["item_id"].dataType))
    return after.drop("document_items").withColumnRenamed("id", "doc_id").select(*documents.columns), append_lines(left, new), refused


def backfill_lines(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Landed documents, with the detail record's lines where the list has none."""
    found = details.select(F.col("id").alias("_id"), F.col("document_items").alias("_items"))
    lacking = F.coalesce(F.size("document_items"), F.lit(0)) <= 0
    return listed.join(found, F.col("id") == F.col("_id"), "left").withColumn("document_items", F.when(lacking, F.col("_items")).otherwise(F.col("document_items"))).drop("_id", "_items")


def sync_state(documents: DataFrame, lines: DataFrame, account: str, now: int, full: bool, previous_full: int | None = None) -> DataFrame:
    """State row after a sync, with the counts of the tables, and its JSON."""
    counts = documents.agg(F.count("*").alias("documentCount")).crossJoin(lines.agg(F.count("*").alias("itemDocumentCount")))  # one row each
    state = F.struct(F.lit(now).cast("long").alias("lastSync"), F.lit(now if full else previous_full).cast("long").alias("lastFullSync"), "documentCount", "itemDocumentCount", F.lit(account).alias("accountName"), F.lit(1).alias("schemaVersion"))
    return counts.select(state.alias("state")).select("state.*", F.to_json("state", {"ignoreNullFields": "false"}).alias("json"))


def read_state(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", STATE).alias("state")).select("state.*")


def freshness(state: DataFrame, now: int, threshold: int = 3600) -> DataFrame:
    """State row with stale: no sync yet, or the last one is longer ago than the threshold."""
    if threshold < 0:
        raise ValueError("the threshold is a number of seconds")
    return state.withColumn("stale", F.coalesce(F.col("lastSync") < F.lit(now - threshold), F.lit(True)))


def table_status(state: DataFrame, now: int, threshold: int = 3600) -> DataFrame:
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return freshness(state, now, threshold).select(
        iso("lastSync").alias("last_sync"), iso("lastFullSync").alias("last_full_sync"), F.col("documentCount").alias("documents"), F.col("itemDocumentCount").alias("lines"), F.col("schemaVersion").alias("schema_version"), F.lit(threshold).alias("threshold"), F.when(F.col("stale"), "STALE").otherwise("FRESH").alias("status")
    )


def sync_summary(kind: str, documents: DataFrame, lines: DataFrame, deleted: int = 0, seconds: float | None = None) -> DataFrame:
    """Result row of a sync from the tables that it handled."""
    counts = documents.agg(F.count("*").alias("documents_processed")).crossJoin(lines.agg(F.count("*").alias("lines_processed")))  # one row each
    return counts.select(F.lit(kind).alias("type"), "documents_processed", "lines_processed", F.lit(deleted).alias("documents_deleted"), F.lit(seconds).cast("double").alias("seconds"))
