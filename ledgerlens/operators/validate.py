"""Normalisation of landed documents, and checks whose failures go to quarantine with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.schemas import ACCOUNT_CONTEXTS, DOCUMENT_CONTEXTS, MONEY


def day_of(value: Column) -> Column:
    """The date before the first T of an ISO time; null if it is none."""
    return F.try_to_date(F.substring_index(value, "T", 1), "yyyy-MM-dd")


def seconds_of(value: Column) -> Column:
    """Whole Unix seconds of an ISO time, rounded down; null if it is none."""
    return F.unix_seconds(F.try_to_timestamp(value))


def normalise_documents(landed: DataFrame, *more: str) -> DataFrame:
    """Header rows of landed documents, and further columns as they are."""
    return landed.select(
        F.col("id").alias("doc_id"), "context_id", F.col("document_number").alias("doc_number"), day_of(F.col("issue_date")).alias("issue_date"), "customer_id", seconds_of(F.col("modified")).alias("modified"), *more
    )


def line_count(lines: str = "document_items") -> Column:
    """How many lines `flatten_lines` makes of a document."""
    return F.coalesce(F.size(F.filter(lines, lambda x: F.coalesce(x["item_id"], F.lit("")) != "")), F.lit(0))


def flatten_lines(landed: DataFrame) -> DataFrame:
    """Line rows of landed documents, without lines that name no item."""
    rows = landed.select(F.col("id").alias("doc_id"), F.explode("document_items").alias("line"))
    return rows.where("line.item_id is not null and line.item_id <> ''").select(F.col("line.item_id").alias("item_id"), "doc_id", F.col("line.quantity").cast(MONEY).alias("quantity"), F.col("line.price").cast(MONEY).alias("price"))


def context_reason(value: Column, accounts: bool = False) -> Column:
    """Why a context id is refused: missing, not a number or out of its domain; null if it is valid."""
    number = value.cast("string").try_cast("int")
    allowed = ACCOUNT_CONTEXTS if accounts else DOCUMENT_CONTEXTS
    return F.when(value.isNull(), "context_id is required").when(number.isNull(), "context_id is not a number").when(~number.isin(*allowed), "context_id is not valid")


def document_reason(lines: str = "document_items") -> Column:
    """The first failing rule of a landed document; null if it is valid."""
    return F.coalesce(
        context_reason(F.col("context_id")),
        F.when(F.coalesce(F.col("customer_id"), F.lit("")) == "", "customer_id is required"),
        F.when(day_of(F.col("issue_date")).isNull(), "issue_date is required"),
        F.when(F.coalesce(F.size(lines), F.lit(0)) < 1, "at least one line is required"),
    )


def split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and refused rows with their reason."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
