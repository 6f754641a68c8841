"""Aggregates of sales lines for every item at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import Window as Dates
from ledgerlens.functions.numeric import double_sum, quarters, ratio, trailing_days, trailing_months
from ledgerlens.operators.selection import exact_medians


def _amount() -> Column:
    return F.expr("cast(quantity * price as decimal(38,8))")


def _sold() -> Column:
    return F.expr("abs(quantity)")


def _total(value: Column, when: Column | None = None) -> Column:
    value = value if when is None else F.when(when, value)
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def of_context(sales: DataFrame, context_id: int, dates: Dates | None = None) -> DataFrame:
    rows = sales.where(F.col("context_id") == context_id)
    return rows if dates is None else rows.where(dates.holds(F.col("issue_date")))


def _last_dates() -> list[Column]:
    last = lambda c: F.max(F.when(F.col("context_id") == c, F.col("issue_date")))
    return [last(4).alias("latest_estimate"), last(5).alias("latest_invoice"), last(11).alias("latest_purchase")]


def latest_dates(sales: DataFrame) -> DataFrame:
    """Latest estimate, invoice and purchase date of each item, whenever that was."""
    return sales.groupBy("item_id").agg(*_last_dates())


def price_distribution(sales: DataFrame, dates: Dates, context_id: int = 5) -> DataFrame:
    """Quantity (absolute) and revenue (signed) at each exact price of an item."""
    return of_context(sales, context_id, dates).groupBy("item_id", "price").agg(_total(_sold()).alias("total_quantity"), _total(_amount()).alias("total_revenue"), F.sum(_sold()).alias("exact_quantity"))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by item and then by these columns, ascending: a sort by ranges."""
    return rows.orderBy("item_id", *columns)


def sales_by_customer(sales: DataFrame, dates: Dates, context_id: int = 5) -> DataFrame:
    """Quantity (absolute), revenue (signed) and number of documents of each customer of an item."""
    rows = of_context(sales, context_id, dates)
    # documents are reduced first: a document of one customer is one row of the second grouping
    by_document = rows.groupBy("item_id", "customer_id", "doc_id").agg(F.sum(_sold()).alias("sold"), F.sum(_amount()).alias("amount"))
    return by_document.groupBy("item_id", "customer_id").agg(_total(F.col("sold")).alias("total_quantity"), _total(F.col("amount")).alias("total_revenue"), F.count("*").alias("order_count"))


def sales_by_month(sales: DataFrame, dates: Dates, context_id: int = 5) -> DataFrame:
    """Quantity (absolute) and revenue (signed) of each calendar month with sales."""
    month = F.date_format("issue_date", "yyyy-MM").alias("month")
    return of_context(sales, context_id, dates).groupBy("item_id", month).agg(_total(_sold()).alias("total_quantity"), _total(_amount()).alias("total_revenue"))


def _period_sums(as_of: date, months: tuple[int, ...]) -> list[Column]:
    invoiced = lambda n: (F.col("context_id") == 5) & trailing_months(as_of, n).holds(F.col("issue_date"))
    return [x for n in months for x in (_total(_sold(), invoiced(n)).alias(f"sold_{n}"), F.abs(_total(_amount(), invoiced(n))).alias(f"revenue_{n}"))]


def period_totals(sales: DataFrame, as_of: date, months: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Sold and absolute revenue of each item in trailing periods, in one pass over the longest: sold_<n>, revenue_<n>."""
    return of_context(sales, 5, trailing_months(as_of, max(months))).groupBy("item_id").agg(*_period_sums(as_of, months))


def item_overview(sales: DataFrame, as_of: date, months: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Latest dates and period totals of each item, in one grouping."""
    return sales.groupBy("item_id").agg(*_last_dates(), *_period_sums(as_of, months))


def long_periods(totals: DataFrame, months: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Period totals as rows (item_id, months, sold, revenue)."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("months"), F.col(f"sold_{n}").alias("sold"), F.col(f"revenue_{n}").alias("revenue")) for n in months]))
    return totals.select("item_id", rows.alias("period")).select("item_id", "period.*")


def quarter_windows(sales: DataFrame, as_of: date) -> DataFrame:
    """Sold and absolute revenue of each item in four chained quarters, oldest first; a border date counts in both neighbours."""
    spans = quarters(as_of)
    whole = Dates(spans[0].start, spans[-1].end)
    day = F.col("issue_date")
    sums = [x for i, w in enumerate(spans, 1) for x in (_total(_sold(), w.holds(day)).alias(f"sold_{i}"), F.abs(_total(_amount(), w.holds(day))).alias(f"revenue_{i}"))]
    return of_context(sales, 5, whole).groupBy("item_id").agg(*sums)


def long_quarters(totals: DataFrame) -> DataFrame:
    """Quarters as rows (item_id, idx, period, sold, revenue, avg_monthly), idx 1 is the oldest."""
    names = ("months_1_3", "months_4_6", "months_7_9", "months_10_12")
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("period"), F.col(f"sold_{i}").alias("sold"), F.col(f"revenue_{i}").alias("revenue")) for i, n in enumerate(names, 1)]))
    return totals.select("item_id", rows.alias("q")).select("item_id", "q.*").withColumn("avg_monthly", F.col("sold") / 3)


def daily_sales(sales: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Absolute quantity of each day with sales in the trailing days."""
    return of_context(sales, 5, trailing_days(as_of, days)).groupBy("item_id", "issue_date").agg(_total(_sold()).alias("sold"))


def total_sums() -> list[Column]:
    return [F.count("*").alias("total_customers"), double_sum(F.col("total_quantity")).alias("total_quantity"), double_sum(F.abs("total_revenue")).alias("total_revenue")]


def item_totals(by_customer: DataFrame) -> DataFrame:
    """Customers, quantity and absolute revenue (by customer) of each item."""
    return by_customer.groupBy("item_id").agg(*total_sums())


def with_totals(rows: DataFrame, *totals: Column) -> DataFrame:
    """Rows with aggregates over their item: partial sums joined back, so an item of many rows is not brought together.

    Both sides come from one shuffle of `rows`, and the join may split a large item.
    """
    return rows.join(rows.groupBy("item_id").agg(*totals), "item_id")


def share_of_total(rows: DataFrame, value: Column, empty: float | None) -> DataFrame:
    """Rows with share: percent of the item's total of `value`, or `empty` where the total is 0."""
    share = ratio(value, F.nullif("_total", F.lit(0.0))) * 100
    return with_totals(rows, double_sum(value).alias("_total")).withColumn("share", share if empty is None else F.coalesce(share, F.lit(empty))).drop("_total")


def order_profile(sales: DataFrame, dates: Dates, by_selection: bool = False) -> DataFrame:
    """Invoice lines of each item: the columns of `order_sizes` and of `size_distribution`.

    Lines are reduced to counts of each quantity first, and an item's mean is joined back to these.  With `by_selection` the median
    is found without a buffer that grows with an item's distinct quantities.
    """
    each = of_context(sales, 5, dates).groupBy("item_id", "quantity").agg(F.count("*").alias("n"), F.min("issue_date").alias("first_date"), F.max("issue_date").alias("last_date"))
    known = F.when(F.col("quantity").isNotNull(), F.col("n"))
    whole = F.sum(F.expr("cast(quantity * n as decimal(38,4))"))
    q, mean = F.col("quantity").cast("double"), F.col("avg_size")
    rows = with_totals(each, ratio(whole, F.sum(known)).alias("avg_size"))
    lines = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    found = rows.groupBy("item_id").agg(
        F.sum("n").alias("total_orders"), F.first("avg_size").alias("avg_size"), *([] if by_selection else [F.percentile(q, 0.5, F.col("n")).alias("median_size")]), F.min(q).alias("min_size"), F.max(q).alias("max_size"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        lines(q < mean / 2).alias("small"), lines((q >= mean / 2) & (q <= mean * 2)).alias("medium"), lines(q > mean * 2).alias("large"),
    )
    if not by_selection:
        return found
    return found.join(exact_medians(each, "item_id", "quantity", "n").withColumnRenamed("median", "median_size"), "item_id", "left")


def order_sizes(sales: DataFrame, dates: Dates) -> DataFrame:
    """Invoice lines of each item: number, mean, median, least and largest signed quantity, and first and last date."""
    return order_profile(sales, dates).drop("small", "medium", "large")


def size_distribution(sales: DataFrame, dates: Dates) -> DataFrame:
    """Invoice lines below half, around and above twice the item's mean quantity."""
    return order_profile(sales, dates).select("item_id", "small", "medium", "large")


def segment_counts() -> list[Column]:
    s = F.col("share")
    return [F.count_if(s > 10).alias("large"), F.count_if(s.between(3, 10)).alias("medium"), F.count_if(s < 3).alias("small")]


def customer_segments(shares: DataFrame) -> DataFrame:
    """Customers with more than 10, 3 to 10 and less than 3 percent of an item's revenue; unknown shares are in none."""
    return shares.groupBy("item_id").agg(*segment_counts())
