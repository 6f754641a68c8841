"""Filters, lookups and pages of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.numeric import Window as Dates


def by_context(documents: DataFrame, context_id: int) -> DataFrame:
    return documents.where(F.col("context_id") == context_id)


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the column of the same name of `keys`."""
    return rows.join(keys.select(key), key, "left_semi")


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == value)


def changed_since(rows: DataFrame, moment: int, modified: str = "modified") -> DataFrame:
    return rows.where(F.col(modified) > moment)


def modified_since(rows: DataFrame, moment: int) -> DataFrame:
    return changed_since(rows, moment).orderBy("modified")


def lines_for_period(sales: DataFrame, dates: Dates, context_id: int, item_id=None) -> DataFrame:
    """Line rows of one context in a period, newest first."""
    rows = sales.where((F.col("context_id") == context_id) & dates.holds(F.col("issue_date")))
    rows = rows if item_id is None else rows.where(F.col("item_id") == item_id)
    return rows.select("item_id", "doc_id", "quantity", "price", "issue_date").orderBy(F.desc("issue_date"), "doc_id", "item_id")


def sales_by_period(sales: DataFrame, dates: Dates, context_id: int, item_id=None) -> DataFrame:
    """Date, quantity and price of the same rows, oldest first."""
    return lines_for_period(sales, dates, context_id, item_id).select("item_id", "issue_date", "quantity", "price").orderBy("issue_date", "item_id")


def order_patterns(sales: DataFrame, dates: Dates, item_id=None) -> DataFrame:
    """Estimate and invoice lines of a period, newest first."""
    rows = sales.where(F.col("context_id").isin(4, 5) & dates.holds(F.col("issue_date")))
    rows = rows if item_id is None else rows.where(F.col("item_id") == item_id)
    return rows.select("item_id", "doc_id", "quantity", "price", "issue_date", "customer_id", "context_id", "doc_number").orderBy(F.desc("issue_date"), "doc_id")


def listed(rows: DataFrame, search_in: tuple[str, ...] = (), keyword: str | None = None, modified_after: int | None = None, **equal) -> DataFrame:
    """Rows that hold the keyword (in any letter case) in one of the columns, with the given values and changed later than a moment."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items() if v is not None]
    if keyword is not None:
        tests.append(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(keyword.lower()), F.lit(False)) for c in search_in)))
    if modified_after is not None:
        tests.append(F.col("modified") > modified_after)
    return reduce(DataFrame.where, tests, rows)


def page(rows: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """One page of the rows in the order of a unique key, by offset and limit: the plan keeps number * size rows at most."""
    return rows.orderBy(key).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The page that follows a key (None: the first page) in the order of a unique key: a filter, and `size` rows kept."""
    return (rows if last is None else rows.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)


def distant_page(rows: DataFrame, key: str, number: int, size: int, ranges: int = 1024, held: int = 10_000) -> DataFrame:
    """`page` by a unique whole-number key, for pages far from the first: about `held` rows are kept, whatever the number.

    Rows are counted by ranges of the key, then by ranges of the one in which the page begins, until that has few rows.
    """
    if not isinstance(rows.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} is no whole number: go from page to page with page_after")
    skip = (number - 1) * size
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.limit(0)
    while True:
        width = -(-(high - low + 1) // ranges)
        place = F.expr(f"cast((cast(`{key}` as decimal(20,0)) - {low}BD) div {width}BD as int)")
        counts = rows.where(F.col(key).between(low, high)).groupBy(place.alias("range")).agg(F.count("*").alias("n")).collect()  # `ranges` rows at most
        for r in sorted(counts):
            if skip < r.n:
                low, high = low + r.range * width, min(high, low + (r.range + 1) * width - 1)
                break
            skip -= r.n
        else:
            return rows.limit(0)
        if r.n <= held or width == 1:
            return rows.where(F.col(key) >= low).orderBy(key).offset(skip).limit(size)
