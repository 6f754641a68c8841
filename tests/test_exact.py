"""Sums that do not depend on the order in which tasks bring their rows."""

import math
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import stats
from ledgerlens.functions.numeric import double_sum
from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import statistics as st
from ledgerlens.plans import reports


def _tenths(spark):
    return spark.range(10).coalesce(1).select(F.lit(1).alias("item_id"), F.concat(F.lit("C"), "id").alias("customer_id"), F.lit(1.0).alias("total_quantity"), F.lit(0.1).alias("total_revenue"))


def test_shares_at_a_border(spark):
    """Ten tenths are one: as doubles they were less, so each was above 10 percent."""
    shares = agg.share_of_total(_tenths(spark), F.abs("total_revenue"), None)
    assert {r.share for r in shares.collect()} == {10.0}
    assert tuple(agg.customer_segments(shares).first()) == (1, 0, 10, 0)


def test_totals_and_top_shares(spark):
    assert agg.item_totals(_tenths(spark)).first().total_revenue == 1.0
    shares = agg.share_of_total(_tenths(spark), F.abs("total_revenue"), None).withColumn("share", F.lit(0.1))
    tops = st.concentration(shares, tops=(3, 10)).first()
    assert (tops.top_3_share, tops.top_10_share) == (0.3, 1.0)
    assert spark.range(10).coalesce(1).agg(stats.herfindahl(F.sqrt(F.lit(1000.0))).alias("h")).first().h == 1.0


def test_volatility_at_a_border(spark):
    """Four months with a spread of exactly 0.2 of their mean, in either order, and values too large for exact squares."""
    for months in ([8.0, 12.0, 8.0, 12.0], [12.0, 12.0, 8.0, 8.0], [0.8, 1.2, 1.2, 0.8]):
        rows = spark.createDataFrame([(x,) for x in months], "q double").coalesce(1)
        assert rows.agg(stats.exact_volatility(F.col("q")).alias("v")).first().v == 0.2
    large = spark.createDataFrame([(1e20,), (3e20,)], "q double")
    assert abs(large.agg(stats.exact_volatility(F.col("q")).alias("v")).first().v - 0.5) < 1e-12
    assert spark.createDataFrame([(0.0,)], "q double").agg(stats.exact_volatility(F.col("q")).alias("v")).first().v == 0.0


def _two(spark, a, b):
    return spark.createDataFrame([(1, "C1", 1.0, a), (1, "C2", 1.0, b)], "item_id int, customer_id string, total_quantity double, total_revenue double").repartition(2)


def test_total_of_two_customers(spark):
    """As doubles these make 74570.09999999999 in either order; as decimals 74570.1, of which the second has 10 percent and no more."""
    shares = agg.share_of_total(_two(spark, 67113.09, 7457.01), F.abs("total_revenue"), None)
    assert {r.share for r in shares.collect()} == {x / (67113.09 + 7457.01) * 100 for x in (67113.09, 7457.01)}
    assert tuple(agg.customer_segments(shares).first()) == (1, 2, 0, 0)


def test_double_sum(spark):
    groups = {1: [0.1] * 10, 2: [1e9, 0.01, -1e9, 0.3], 3: [26081.72, 1 / 3, 2.5e-3] * 7, 4: [1e-4] * 3 + [2.0**-70], 5: [3e18, 2e18, 0.25], 6: [None], 7: [0.0, -0.0]}
    rows = spark.createDataFrame([(g, x) for g, values in groups.items() for x in values], "g int, x double").repartition(5)
    found = {r.g: r.s for r in rows.groupBy("g").agg(double_sum(F.col("x")).alias("s")).collect()}
    assert found[6] is None and found[4] == 3e-4 and found[5] == 5e18
    assert all(found[g] == math.fsum(groups[g]) for g in (1, 2, 3, 7))


def _sold(spark, *revenues):
    """An item's invoices, one of each customer."""
    rows = [(1, f"I{n}", 5, n, date(2001, 7, 1), f"C{n}", Decimal(1), Decimal(str(x))) for n, x in enumerate(revenues)]
    types = "item_id int, doc_id string, context_id int, doc_number int, issue_date date, customer_id string, quantity decimal(18,4), price decimal(18,4)"
    return spark.createDataFrame(rows, types), spark.createDataFrame([(1, "x")], "id int, name string")


def test_top_share_at_a_border(spark):
    """The first three shares add up to 93.25 as doubles from the largest on; as decimals they were less, so 93.2."""
    row = reports.customers(*_sold(spark, 82748.16, 69479.2, 42627.84, 14104.8), date(2001, 8, 1)).first()
    assert (row.total_revenue, row.top_3_share, row.top_5_share) == (208960.0, 93.3, 100.0)
    assert reports.customers(*_sold(spark, 2, 0, 0), date(2001, 8, 1)).first().top_3_share == 100.0


def test_share_of_a_first_customer(spark):
    """A share that is 31.25 in decimals and less as doubles, in either order."""
    sales, _ = _sold(spark, 9544.04, 4338.2)
    found = {r.customer_id: r.share_pct for r in reports.customers_top(sales, date(2001, 8, 1)).collect()}
    assert found == {"C0": 68.8, "C1": 31.2}
