"""Operators and reports on a small hand-made catalogue."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions.numeric import Window, trailing_months
from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import facts, lookups, matching
from ledgerlens.operators import statistics as st
from ledgerlens.plans import reports

AS_OF = date(2026, 2, 1)


def documents(spark, rows):
    return spark.createDataFrame([(d, c, n, date.fromisoformat(day), who, 0) for d, c, n, day, who in rows], schemas.DOCUMENTS)


def lines(spark, rows):
    return spark.createDataFrame([(i, d, Decimal(str(q)), Decimal(str(p))) for i, d, q, p in rows], schemas.LINES)


@pytest.fixture(scope="module")
def shop(spark):
    docs = [
        ("i1", 5, 1, "2025-03-10", "a"), ("i2", 5, 2, "2025-06-10", "b"), ("i3", 5, 3, "2025-08-20", "a"), ("i4", 5, 4, "2025-11-01", "a"), ("i5", 5, 5, "2026-01-15", "c"),
        ("i6", 5, 5, "2026-01-20", "c"), ("e1", 4, 5, "2026-01-10", "c"), ("e2", 4, 9, "2025-12-01", "b"), ("e3", 4, 10, "2026-01-25", "b"), ("p1", 11, 11, "2025-10-01", "s"), ("r1", 5, 12, "2026-01-05", "b"),
    ]
    rows = [(1, "i1", 10, 25), (1, "i2", 5, 20), (1, "i3", 5, 20), (1, "i4", 8, 25), (1, "i5", 4, 22.5), (1, "i6", 2.5, 25), (1, "e1", 4, 22.5), (1, "e2", 3, 25), (1, "e3", 3, 25), (1, "p1", 50, 9), (1, "r1", -3, 25), (2, "i4", 1, 10), (9, "lost", 1, 1)]
    items = spark.createDataFrame([(1, "one", 12.0, 6.0, 25.0), (2, "two", 0.0, None, 10.0), (3, "none", 4.0, 0.0, None)], "id long, name string, quantity double, cost double, price double")
    held = facts.sales_lines(lines(spark, rows), documents(spark, docs))
    return held, items


def by_item(df):
    return {r["item_id"]: r.asDict() for r in df.collect()}


def test_lines_without_a_document_drop_out(shop):
    assert shop[0].where("item_id = 9").count() == 0


def test_price_distribution_uses_absolute_quantity_and_signed_revenue(shop):
    rows = {float(r.price): (r.total_quantity, r.total_revenue) for r in agg.price_distribution(shop[0], trailing_months(AS_OF, 12)).where("item_id = 1").collect()}
    assert rows == {20.0: (10, 200), 22.5: (4, 90), 25.0: (23.5, 25 * (10 + 8 + 2.5 - 3))}


def test_mode_price_tie_takes_the_lowest(spark):
    rows = spark.createDataFrame([(1, Decimal(10), Decimal(5)), (1, Decimal(15), Decimal(10)), (1, Decimal(20), Decimal(10)), (2, Decimal(7), Decimal(0))], "item_id long, price decimal(18,4), exact_quantity decimal(28,4)")
    found = by_item(st.discounts(rows))
    assert found[1]["mode_price"] == 15 and found[1]["has_discounts"] and found[1]["discount_frequency"] == pytest.approx(5 / 25)
    assert not found[2]["has_discounts"] and found[2]["avg_discount_pct"] is None
    prices = by_item(st.price_stats(rows))
    assert prices[2]["std_dev"] == 0 and prices[1]["median_price"] == 15


def test_documents_are_counted_once_for_a_customer(spark):
    docs = documents(spark, [("i1", 5, 1, "2026-01-01", "a"), ("i2", 5, 2, "2026-01-02", "a")])
    held = facts.sales_lines(lines(spark, [(1, "i1", 1, 2), (1, "i1", 2, 2), (1, "i2", 1, 2)]), docs)
    row = agg.sales_by_customer(held, trailing_months(AS_OF, 12)).first()
    assert (row.order_count, row.total_quantity, row.total_revenue) == (2, 4, 8)


def test_border_date_counts_in_both_quarters(shop):
    rows = {r.idx: r.sold for r in agg.long_quarters(agg.quarter_windows(shop[0], AS_OF)).where("item_id = 1").collect()}
    assert rows == {1: 10, 2: 5, 3: 13, 4: 8 + 4 + 2.5 + 3}


def test_trend_by_hand(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([25.0, 20.0, 15.0, 10.0], 1)] + [(2, i, v) for i, v in enumerate([0.0, 10.0, 10.0, 11.0], 1)], "item_id long, idx int, avg_monthly double")
    found = by_item(st.trend(rows))
    assert (found[1]["direction"], found[1]["momentum"], found[1]["growth_rate"]) == ("volatile", "decelerating", -0.6)
    assert found[2]["growth_rate"] == 1.0


def test_newest_invoice_matches_and_ties_take_the_lowest_id(shop, spark):
    found = matching.match_estimates(shop[0], trailing_months(AS_OF, 12))
    assert {(r.doc_id, r.invoice_id) for r in found.collect()} == {("e1", "i6"), ("e2", None), ("e3", None)}
    row = matching.win_rate(found, AS_OF).first()
    assert (row.created, row.converted, row.open, row.lost, row.win_rate) == (3, 1, 1, 1, 0.333)
    assert matching.cycle_time(found).first().avg_cycle_days == 10.0
    docs = documents(spark, [("e", 4, 1, "2026-01-01", "a"), ("y", 5, 1, "2026-01-02", "a"), ("x", 5, 1, "2026-01-02", "a")])
    held = facts.sales_lines(lines(spark, [(1, d, 1, 1) for d in "exy"]), docs)
    assert matching.match_estimates(held, trailing_months(AS_OF, 12)).first().invoice_id == "x"


def test_purchases_are_no_order_patterns(shop):
    rows = lookups.order_patterns(shop[0], trailing_months(AS_OF, 12))
    assert rows.where("context_id = 11").count() == 0
    assert [r.issue_date for r in rows.collect()] == sorted((r.issue_date for r in rows.collect()), reverse=True)


def test_period_is_inclusive(shop):
    dates = Window(date(2025, 6, 10), date(2025, 11, 1))
    assert lookups.lines_for_period(shop[0], dates, 5, 1).count() == 3
    assert [r.issue_date for r in lookups.sales_by_period(shop[0], dates, 5, 1).collect()] == [date(2025, 6, 10), date(2025, 8, 20), date(2025, 11, 1)]


def test_every_item_has_a_row_in_every_report(shop):
    held, items = shop
    for report in (reports.item_sales, reports.trends, reports.inventory, reports.pricing, reports.customers, reports.forecast, reports.patterns):
        found = by_item(report(held, items, AS_OF))
        assert set(found) == {1, 2, 3}, report.__name__


def test_report_values(shop):
    held, items = shop
    sales = by_item(reports.item_sales(held, items, AS_OF))
    assert (sales[1]["sold_3"], sales[1]["latest_purchase"], sales[3]["sold_12"]) == (8 + 4 + 2.5 + 3, date(2025, 10, 1), 0)
    stock = by_item(reports.inventory(held, items, AS_OF))
    assert stock[2]["stock_status"] == "critical" and stock[2]["days_of_stock"] is None
    assert stock[3]["stock_status"] == "adequate" and stock[3]["days_of_stock"] is None
    pattern = by_item(reports.patterns(held, items, AS_OF))
    assert pattern[1]["total_orders"] == 7 and pattern[1]["min_size"] == -3 and pattern[3]["win_rate"] is None and pattern[3]["total_orders"] == 0
    prices = by_item(reports.pricing(held, items, AS_OF))
    assert prices[2]["std_dev"] == 0 and prices[3]["avg_price"] == 0


def test_unknown_shares_are_in_no_segment(spark):
    docs = documents(spark, [("i1", 5, 1, "2026-01-01", "a"), ("i2", 5, 2, "2026-01-02", "b")])
    held = facts.sales_lines(lines(spark, [(1, "i1", 1, 0), (1, "i2", 2, 0)]), docs)
    items = spark.createDataFrame([(1, "x", 0.0, 0.0, 0.0)], "id long, name string, quantity double, cost double, price double")
    row = reports.customers(held, items, AS_OF).first()
    assert (row.total_customers, row.top_3_share, row.large_customers, row.small_customers, row.herfindahl) == (2, None, 0, 0, 0)


def test_forecast_divides_growth_by_six(spark):
    months = ["2025-09-05", "2025-10-05", "2025-11-05"]
    docs = documents(spark, [(f"i{k}", 5, k, d, "a") for k, d in enumerate(months)])
    held = facts.sales_lines(lines(spark, [(1, f"i{k}", q, 10) for k, q in enumerate([10, 12, 15])]), docs)
    items = spark.createDataFrame([(1, "x", 0.0, 0.0, 10.0), (2, "y", 0.0, 0.0, 5.0)], "id long, name string, quantity double, cost double, price double")
    rows = {(r.item_id, r.month): (r.predicted_quantity, r.predicted_revenue) for r in reports.forecast_months(held, items, AS_OF).collect()}
    assert rows == {(1, "2026-03"): (13, 130), (1, "2026-04"): (14, 140), (1, "2026-05"): (15, 150), (2, "2026-03"): (0, 0), (2, "2026-04"): (0, 0), (2, "2026-05"): (0, 0)}


def test_report_of_all_items_equals_report_of_one(shop):
    held, items = shop
    whole = by_item(reports.patterns(held, items, AS_OF))[1]
    alone = by_item(reports.patterns(held.where("item_id = 1"), items.where("id = 1"), AS_OF))[1]
    assert whole == alone


def test_top_customers_and_names(shop, spark):
    names = spark.createDataFrame([("a", "Ann")], "id string, name string")
    rows = reports.customers_top(shop[0], AS_OF, names).where("item_id = 1").orderBy("rank").collect()
    assert [r.customer_name for r in rows][0] == "Ann" and rows[-1].customer_id == "b"
    assert sum(r.share_pct for r in rows) == pytest.approx(100, abs=0.2)


@pytest.mark.parametrize("name", ["item_sales", "trends", "inventory", "pricing", "customers", "forecast", "patterns"])
def test_a_report_of_chosen_items_equals_its_rows_of_all(spark, shop, name):
    report = getattr(reports, name)
    rows = by_item(report(*shop, AS_OF))
    assert set(rows) == {1, 2, 3}
    assert by_item(report(*reports.of_item(*shop, 1), AS_OF)) == {1: rows[1]}
    wanted = spark.createDataFrame([(2,), (3,), (77,)], "id long")
    assert by_item(report(*reports.of_items(*shop, wanted), AS_OF)) == {k: rows[k] for k in (2, 3)}


def test_item_filter_reaches_the_scans(spark, tmp_path):
    spark.range(9).selectExpr("id as item_id", "'d' as doc_id", "cast(1 as decimal(18,4)) as quantity", "cast(1 as decimal(18,4)) as price").write.parquet(str(tmp_path / "lines"))
    documents(spark, [("d", 5, 1, "2026-01-15", "c")]).write.parquet(str(tmp_path / "documents"))
    items = spark.range(9).selectExpr("id", "cast(id as string) as name", "1.0D as quantity", "1.0D as cost", "1.0D as price")
    sales = facts.sales_lines(spark.read.parquet(str(tmp_path / "lines")), spark.read.parquet(str(tmp_path / "documents")))
    plan = reports.item_sales(*reports.of_item(sales, items, 4), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(item_id,4)" in plan


def test_sales_of_chosen_periods_with_freshness(shop):
    found = reports.item_sales_with_freshness(*shop, AS_OF, {"lastSync": 1_000_000}, 1_003_600, (12, 3))
    assert found.columns == ["item_id", "item_name", "stock", "latest_estimate", "latest_purchase", "sold_12", "revenue_12", "sold_3", "revenue_3", "last_sync", "stale"]
    row = found.where("item_id = 1").first()
    assert (row.last_sync, row.stale, row.sold_3) == ("1970-01-12T13:46:40.000Z", False, 8 + 4 + 2.5 + 3)
    never = reports.item_sales_with_freshness(*shop, AS_OF, None, 0, ()).first()
    assert (never.last_sync, never.stale) == ("unknown", True)


def test_prices_and_months_are_sorted(shop):
    prices = [(r.item_id, r.price) for r in agg.in_order(agg.price_distribution(shop[0], trailing_months(AS_OF, 12)), "price").collect()]
    months = [(r.item_id, r.month) for r in agg.in_order(agg.sales_by_month(shop[0], trailing_months(AS_OF, 12)), "month").collect()]
    assert prices == sorted(prices) and months == sorted(months) and len(months) > 4
    assert [r.price for r in reports.pricing_distribution(shop[0], AS_OF).where("item_id = 1").collect()] == [20.0, 22.5, 25.0]


def test_sizes_are_those_of_single_lines(spark, shop):
    q = sorted([10, 5, 5, 8, 4, 2.5, -3])
    mean = sum(q) / len(q)
    row = agg.order_profile(shop[0], trailing_months(AS_OF, 12)).where("item_id = 1").first()
    assert (row.total_orders, row.avg_size, row.median_size, row.min_size, row.max_size) == (7, mean, 5.0, -3.0, 10.0)
    assert (row.small, row.medium, row.large) == (sum(x < mean / 2 for x in q), sum(mean / 2 <= x <= mean * 2 for x in q), sum(x > mean * 2 for x in q))
