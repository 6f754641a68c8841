"""Landed pages of documents, items, customers, categories and locations, and change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas


def _pages(spark: SparkSession, path: str, schema: str, field: str, nested: bool) -> DataFrame:
    pages = spark.read.schema(schema).json(path)
    return pages.select(F.explode(F.flatten(field) if nested else F.col(field)).alias("row")).select("row.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all pages, lines nested; empty pages give no rows."""
    return _pages(spark, path, schemas.DOCUMENT_PAGE, "documents", True)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, schemas.ITEM_PAGE, "items", False)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, schemas.CUSTOMER_PAGE, "customers", False)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, schemas.CATEGORY_PAGE, "categories", True)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, schemas.LOCATION_PAGE, "locations", True)


def as_pages(rows: DataFrame, field: str, key: str, nested: bool, size: int = 50) -> DataFrame:
    """Page records of rows, as a service lists them: pages of about `size` rows, dealt by a hash of the key."""
    count = rows.count()
    pages = max(1, -(-count // size))
    grouped = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(pages)).alias("page")).agg(F.collect_list(F.struct(*rows.columns)).alias("held"))
    return _page_records(grouped, field, nested, count, pages)


def _page_records(grouped: DataFrame, field: str, nested: bool, count: int, pages: int) -> DataFrame:
    body: Column = F.array("held") if nested else F.col("held")
    return grouped.select(F.lit(count).alias("count"), (F.col("page") + 1).alias("page"), F.lit(str(pages)).alias("pages"), body.alias(field))


def nested_documents(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents as a service gives them, with their lines nested and times in ISO form."""
    held = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(line())).alias("document_items"))
    return as_landed(documents.join(held, "doc_id", "left"))


def as_landed(documents: DataFrame) -> DataFrame:
    """Headers with their nested lines (column document_items) as a service gives them."""
    return documents.select(*_landed_fields())


def line() -> Column:
    """A nested line."""
    return F.struct(F.col("item_id").cast("string").alias("item_id"), F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"))


def _landed_fields() -> list[Column]:
    iso = F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return [
        F.col("doc_id").alias("id"), "context_id", F.col("doc_number").alias("document_number"), "customer_id", F.concat(F.col("issue_date").cast("string"), F.lit("T00:00:00Z")).alias("issue_date"), iso.alias("modified"), F.col("document_items")
    ]


def document_pages(documents: DataFrame, lines: DataFrame, size: int = 50) -> DataFrame:
    """`as_pages` of `nested_documents`, with headers and lines dealt once, by the page of their document."""
    count = documents.count()
    pages = max(1, -(-count // size))
    page = F.pmod(F.xxhash64("doc_id"), F.lit(pages)).alias("page")
    header = [c for c in documents.columns if c != "doc_id"]
    blank = F.lit(None).cast(documents.select(F.struct(*header).alias("header")).schema["header"].dataType)
    rows = documents.select(page, "doc_id", F.struct(*header).alias("header"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("item_id", "quantity", "price")])
    both = rows.unionByName(lines.select(page, "doc_id", blank.alias("header"), "item_id", "quantity", "price")).repartition("page")
    own = F.when(F.col("header").isNull(), line())
    # headers that repeat an id have the same lines each
    held = both.groupBy("page", "doc_id").agg(F.collect_list("header").alias("headers"), F.sort_array(F.collect_list(own)).alias("items"))
    nested = held.select("page", "doc_id", F.explode("headers").alias("header"), F.when(F.size("items") > 0, F.col("items")).alias("document_items")).select("page", "doc_id", "header.*", "document_items")
    grouped = nested.select("page", F.struct(*_landed_fields()).alias("row")).groupBy("page").agg(F.collect_list("row").alias("held"))
    return _page_records(grouped, "documents", True, count, pages)


def read_changes(spark: SparkSession, path: str, payload: str, wrapper: str) -> tuple[DataFrame, DataFrame]:
    """Change records, and those refused: not JSON, or without content.

    A record is the payload itself or an object that holds it under `wrapper`; `payload` is its struct type.
    """
    text = spark.read.text(path)
    wrapped = F.from_json("value", f"struct<{wrapper}:{payload}>")[wrapper]
    bare = F.from_json("value", payload)
    rows = text.select("value", F.coalesce(wrapped, bare).alias("row"))
    # an object that has none of the fields gives a struct of nulls
    empty = F.coalesce(F.to_json("row") == "{}", F.lit(True))
    return rows.where(~empty).select("row.*"), rows.where(empty).select("value", F.lit("no valid change").alias("reason"))


def write_json(report: DataFrame, path: str) -> None:
    """A report as JSON lines; nulls are written out."""
    report.write.option("ignoreNullFields", "false").json(path)
