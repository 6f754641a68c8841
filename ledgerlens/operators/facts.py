"""Joins of lines with their headers and with the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sales_lines(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Each line with the fields of its document; lines without a document drop out."""
    headers = documents.select("doc_id", "context_id", "doc_number", "issue_date", "customer_id")
    return lines.join(headers, "doc_id").select("item_id", "doc_id", "context_id", "doc_number", "issue_date", "customer_id", "quantity", "price")


def _item_facts(quantity: str, cost: str, price: str) -> dict[str, Column]:
    return {
        "stock": F.coalesce(F.col(quantity).cast("double"), F.lit(0.0)),
        "unit_cost": F.nullif(F.col(cost).cast("double"), F.lit(0.0)),
        "list_price": F.when(F.col(price) > 0, F.col(price).cast("double")).otherwise(0.0),
    }


def catalogue(items: DataFrame) -> DataFrame:
    """Rows (item_id, item_name, stock, unit_cost, list_price), one per item."""
    facts = [c.alias(n) for n, c in _item_facts("quantity", "cost", "price").items()]
    return items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), *facts)


def with_item(rows: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Rows with item_name, stock, cost and list_price; a missing item has no name and cost, and 0 for the others."""
    facts = items.select(F.col("id").alias("_item"), F.col("name").alias("item_name"), F.col("quantity").alias("_q"), F.col("cost").alias("_c"), F.col("price").alias("_p"))
    joined = rows.join(facts, F.col(item_id) == F.col("_item"), "left")
    return joined.withColumns(_item_facts("_q", "_c", "_p")).drop("_item", "_q", "_c", "_p")


def with_customer_name(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows with customer_name, which is the id where the customer is unknown."""
    names = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("_name"))
    return rows.join(names, "customer_id", "left").withColumn("customer_name", F.coalesce("_name", "customer_id")).drop("_name")


def orphan_lines(lines: DataFrame, documents: DataFrame) -> DataFrame:
    return lines.join(documents.select("doc_id"), "doc_id", "left_anti")
