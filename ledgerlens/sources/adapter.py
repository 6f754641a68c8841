"""Sales tables derived from an order schema (orders, lineitem, part, customer, supplier, nation)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.schemas import MONEY
from ledgerlens.sources import landing

AS_OF = date(2001, 8, 1)


@dataclass(frozen=True)
class SalesTables:
    documents: DataFrame
    lines: DataFrame
    numbered: DataFrame
    sales: DataFrame
    nested: DataFrame
    items: DataFrame
    customers: DataFrame
    categories: DataFrame
    locations: DataFrame


def _kinds() -> Column:
    """An order's documents: its estimate, and its invoice or purchase order."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return F.array(
        F.struct(F.lit("E").alias("prefix"), F.lit(4).alias("context_id"), day.alias("issue_date")),
        F.when(F.col("o_orderstatus") == "O", F.struct(F.lit("P").alias("prefix"), F.lit(11).alias("context_id"), day.alias("issue_date"))).otherwise(
            F.struct(F.lit("I").alias("prefix"), F.lit(5).alias("context_id"), F.date_add(day, (key * 7 % 45).cast("int")).alias("issue_date"))
        ),
    )


def _documents(orders: DataFrame) -> DataFrame:
    return _headers(orders.withColumn("kind", F.explode(_kinds())))


def _headers(rows: DataFrame, *more: str) -> DataFrame:
    """Headers of orders with one kind each, and further columns as they are."""
    rows = rows.select(F.col("o_orderkey").alias("doc_number"), F.concat(F.lit("C"), F.col("o_custkey")).alias("customer_id"), "kind", *more)
    return rows.select(
        F.concat("kind.prefix", "doc_number").alias("doc_id"), "kind.context_id", "doc_number", "kind.issue_date", "customer_id", F.unix_date("kind.issue_date").cast("long").alias("day"), *more
    ).withColumn("modified", F.col("day") * 86400).drop("day")


def sales_tables(spark: SparkSession, sf_dir: str) -> SalesTables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, part = read("orders"), read("part")
    documents = _documents(orders)
    prices = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").cast("decimal(12,2)").alias("list"))
    priced = read("lineitem").join(prices, "l_partkey").select(
        "l_orderkey", "l_partkey", F.col("l_quantity").cast(MONEY).alias("quantity"), F.round(F.col("list") * (1 - F.col("l_discount").cast("decimal(5,2)")), 2).cast(MONEY).alias("price")
    )
    # a line stands on the order's estimate and on its invoice or purchase order
    second = F.when(F.col("o_orderstatus") == "O", "P").otherwise("I")
    # `numbered`: with the order's key, by which they are dealt
    numbered = priced.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").select(
        F.col("l_orderkey").alias("doc_number"), F.col("l_partkey").alias("item_id"), F.explode(F.array(F.concat(F.lit("E"), "l_orderkey"), F.concat(second, "l_orderkey"))).alias("doc_id"), "quantity", "price"
    )
    lines = numbered.drop("doc_number")
    # `facts.sales_lines` of both, by the order's key, by which the lines are dealt already: they do not meet their headers by document too
    prefix = F.col("kind.prefix")
    ordered = priced.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), second.alias("second")), "l_orderkey")
    both = ordered.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("kind", F.explode(_kinds())).where((prefix == "E") | (prefix == F.col("second")))
    sales = both.select(
        F.col("l_partkey").alias("item_id"), F.concat(prefix, "l_orderkey").alias("doc_id"), "kind.context_id", F.col("o_orderkey").alias("doc_number"), "kind.issue_date", F.concat(F.lit("C"), F.col("o_custkey")).alias("customer_id"), "quantity", "price"
    )
    # headers with what `landing.nested_documents` nests, by the order's key: an order's lines are dealt once for all its documents
    held = priced.withColumnRenamed("l_partkey", "item_id").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(landing.line()).alias("held"))
    same, bought = Window.partitionBy("o_orderkey"), F.col("o_orderstatus") == "O"
    # a key that comes again repeats its lines, on the documents of its kinds
    counted = orders.withColumns({"_all": F.count("*").over(same), "_bought": F.count(F.when(bought, 1)).over(same)})
    times = F.when(prefix == "E", F.col("_all")).when(prefix == "P", F.col("_bought")).otherwise(F.col("_all") - F.col("_bought"))
    nested = _headers(counted.join(held, "o_orderkey", "left").withColumn("kind", F.explode(_kinds())).withColumn("document_items", F.sort_array(F.flatten(F.array_repeat("held", times.cast("int"))))), "document_items")
    category = F.concat_ws("/", "p_type", "p_brand")
    list_price = F.col("p_retailprice").cast("decimal(12,2)")
    items = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.concat(F.lit("SKU-"), "p_partkey").alias("sku"), category.alias("category_id"),
        F.col("p_size").cast(MONEY).alias("quantity"), F.when(F.col("p_partkey") % 10 != 0, F.round(list_price * F.lit("0.6").cast("decimal(2,1)"), 2).cast(MONEY)).alias("cost"),
        list_price.cast(MONEY).alias("price"), (F.col("p_partkey") * 1000).alias("modified"),
    )
    customers = (
        read("customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit(2).alias("context_id"), F.col("c_name").alias("name"), F.lower(F.concat(F.lit("c"), "c_custkey", F.lit("@example.com"))).alias("office_email"), (F.col("c_custkey") * 1000).alias("modified"))
        .unionByName(read("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit(10).alias("context_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("office_email"), (F.col("s_suppkey") * 1000).alias("modified")))
    )
    kinds = part.groupBy("p_type", "p_brand").agg(F.count("*").alias("item_count"))
    categories = kinds.select(F.concat_ws("/", "p_type", "p_brand").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("parent_id"), "item_count").unionByName(
        kinds.groupBy("p_type").agg(F.sum("item_count").alias("item_count")).select(F.col("p_type").alias("id"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("parent_id"), "item_count")
    )
    locations = read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.expr("left(n_name, 3)").alias("short_name"))
    return SalesTables(documents, lines, numbered, sales, nested, items, customers, categories, locations)
