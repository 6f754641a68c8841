"""Estimates matched with the invoices that came of them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import stats
from ledgerlens.functions.numeric import Window as Dates
from ledgerlens.functions.numeric import js_round, ratio

KEYS = ["item_id", "doc_number", "customer_id"]


def match_estimates(sales: DataFrame, dates: Dates) -> DataFrame:
    """Estimate lines of a period with the newest invoice (then the lowest id) of the same item, number and customer, or null.

    Both kinds are dealt once by their common key; keys are fine, so no item gathers in one task.
    """
    rows = sales.where(dates.holds(F.col("issue_date")) & F.col("context_id").isin(4, 5))
    invoice = F.when(F.col("context_id") == 5, F.struct((-F.unix_date("issue_date")).alias("age"), "doc_id", "issue_date"))
    newest = F.min(invoice).over(Window.partitionBy(*KEYS))
    estimates = rows.withColumn("newest", newest).where("context_id = 4")
    return estimates.select(*KEYS, "doc_id", "issue_date", "quantity", "price", F.col("newest.doc_id").alias("invoice_id"), F.col("newest.issue_date").alias("invoice_date"))


def converted(matched: DataFrame) -> DataFrame:
    return matched.where("invoice_id is not null")


def unconverted(matched: DataFrame) -> DataFrame:
    return matched.where("invoice_id is null")


def outcomes(matched: DataFrame, as_of: date | None = None) -> DataFrame:
    """For each item, in one grouping: the columns of `cycle_time` and, with a date, of `win_rate`."""
    hit = F.col("invoice_id").isNotNull()
    days = F.when(hit, stats.days_between(F.col("issue_date"), F.col("invoice_date")))
    sums = [js_round(stats.mean(days), 1).alias("avg_cycle_days"), js_round(stats.median(days), 1).alias("median_cycle_days")]
    if as_of is None:
        return matched.groupBy("item_id").agg(*sums)
    late = F.datediff(F.lit(as_of), F.col("issue_date")) > stats.LOST_AFTER_DAYS
    sums += [F.count("*").alias("created"), F.count_distinct(F.when(hit, F.col("doc_id"))).alias("converted"), F.count_if(~hit & ~late).alias("open"), F.count_if(~hit & late).alias("lost")]
    return matched.groupBy("item_id").agg(*sums).withColumn("win_rate", js_round(ratio(F.col("converted"), F.col("created")), 3))


def cycle_time(matched: DataFrame) -> DataFrame:
    """Mean and median days from estimate to invoice over matched lines, to 0.1; 0 without a match."""
    return outcomes(matched)


def win_rate(matched: DataFrame, as_of: date) -> DataFrame:
    """Lines created, distinct documents converted, unmatched lines open and lost, and converted / created to 3 places."""
    return outcomes(matched, as_of).drop("avg_cycle_days", "median_cycle_days")
