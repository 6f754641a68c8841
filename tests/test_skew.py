"""Items of very many lines, customers or prices: plans without an item in one task, medians by selection."""

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import trailing_months
from ledgerlens.operators import aggregates as agg
from ledgerlens.operators.selection import exact_medians
from ledgerlens.plans import reports
from ledgerlens.sources.adapter import AS_OF

SALES = "item_id long, doc_id string, context_id int, doc_number long, issue_date date, customer_id string, quantity decimal(18,4), price decimal(18,4)"


@pytest.fixture(scope="module")
def skewed(spark):
    """Sales of which half belong to item 0, each line at a price and to a customer of its own."""
    n = F.col("id")
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(n % 2 == 0, 0).otherwise(n % 50 + 1).cast("long").alias("item_id"), F.concat(F.lit("I"), n).alias("doc_id"), F.lit(5).alias("context_id"), n.alias("doc_number"), F.date_sub(F.lit(AS_OF), (n % 300).cast("int")).alias("issue_date"),
        F.concat(F.lit("C"), F.when(n % 2 == 0, n).otherwise(n % 97)).alias("customer_id"), (n % 11 + 1).cast("decimal(18,4)").alias("quantity"), ((n * 37 % 20011) / 100 + 1).cast("decimal(18,4)").alias("price"),
    )
    items = spark.range(51).select(n.alias("id"), F.concat(F.lit("item "), n).alias("name"), *[F.lit(1).cast("decimal(18,4)").alias(c) for c in ("quantity", "cost", "price")])
    return rows.cache(), items


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_no_window_gathers_an_item(skewed):
    sales, items = skewed
    assert "Window" not in plan(reports.pricing(sales, items, AS_OF))[0]
    assert "Window" not in plan(agg.order_profile(sales, trailing_months(AS_OF, 12)))[0]
    assert "Window" not in plan(reports.customer_shares(sales, AS_OF))[0]
    # ranks are taken in each task first
    for df in (reports.customers(sales, items, AS_OF), reports.customers_top(sales, AS_OF)):
        assert "Window" in plan(df)[0] and plan(df)[1].count("WindowGroupLimit") == 2


def test_reports_of_a_hot_item(spark, skewed):
    sales, items = skewed
    rows = [r for r in sales.collect() if r.item_id == 0]
    amounts = defaultdict(float)
    for r in rows:
        amounts[r.customer_id] += float(r.quantity * r.price)
    total, largest = sum(amounts.values()), sorted(amounts.values(), reverse=True)
    found = reports.customers(sales, items, AS_OF).where("item_id = 0").first()
    assert found.total_customers == 20_000 == len(amounts) and found.small_customers == 20_000
    assert found.top_3_share == round(100 * sum(largest[:3]) / total, 1) and found.top_5_share == round(100 * sum(largest[:5]) / total, 1)
    prices = reports.pricing(sales, items, AS_OF).where("item_id = 0").first()
    assert prices.max_price == float(max(r.price for r in rows)) and prices.median_price == pytest.approx(median({float(r.price) for r in rows}), abs=0.006)
    assert prices.avg_price == pytest.approx(total / sum(float(r.quantity) for r in rows), abs=0.006)


def test_medians_by_selection(spark, skewed):
    pick = random.Random(7)
    rows = [(k, pick.choice([None, 0, -3, 5, 10**13, -(10**13), pick.randrange(-(10**6), 10**6)]), pick.randint(1, 4)) for k in range(40) for _ in range(pick.randint(1, 9))]
    rows += [(100, None, 1), (None, 3, 1)]
    table = spark.createDataFrame(rows, "k long, v long, n int")
    for count in (None, "n"):
        want = defaultdict(list)
        for k, v, n in rows:
            if v is not None and k is not None:
                want[k] += [v] * (n if count else 1)
        found = {r.k: r.median for r in exact_medians(table, "k", "v", count).collect()}
        assert found == {k: float(median(v)) for k, v in want.items()}
    sales, _ = skewed
    plain = {r.item_id: r.m for r in sales.groupBy("item_id").agg(F.median(F.col("price").cast("double")).alias("m")).collect()}
    found = {r.item_id: r.median for r in exact_medians(sales, "item_id", "price").collect()}
    assert found.keys() == plain.keys() and all(found[k] == pytest.approx(plain[k], abs=1e-9) for k in plain)


def test_reports_with_medians_by_selection(skewed):
    sales, items = skewed
    for report in (reports.pricing, reports.patterns):
        own, plain = (sorted(map(str, report(sales, items, AS_OF, by_selection=x).collect())) for x in (True, False))
        assert own == plain
    text = plan(reports.pricing(sales, items, AS_OF, by_selection=True))[0]
    assert "median(" not in text and "percentile" not in text
