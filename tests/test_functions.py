"""Known answers of rounding, dates and statistics."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numeric, stats


def one(spark, values, expression, kind="double"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return rows.agg(expression(F.col("x")).alias("y")).first()[0]


def scalar(spark, expression):
    return spark.range(1).select(expression.alias("y")).first()[0]


@pytest.mark.parametrize("value, places, want", [(-2.5, 0, -2.0), (1.005, 2, 1.0), (2.5, 0, 3.0), (None, 2, None)])
def test_js_round(spark, value, places, want):
    assert scalar(spark, numeric.js_round(F.lit(value).cast("double"), places)) == want


def test_ratio_by_zero_is_null(spark):
    assert scalar(spark, numeric.ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize("day, months, want", [(date(2025, 5, 31), 3, date(2025, 3, 3)), (date(2001, 8, 1), 12, date(2000, 8, 1)), (date(2024, 3, 30), 1, date(2024, 3, 1)), (date(2025, 1, 15), 1, date(2024, 12, 15))])
def test_months_back_overflows(day, months, want):
    assert numeric.months_back(day, months) == want


def test_quarters_share_borders():
    spans = numeric.quarters(date(2001, 8, 1))
    assert [a.end for a in spans[:-1]] == [b.start for b in spans[1:]]
    assert spans[0].start == date(2000, 8, 1) and spans[-1].end == date(2001, 8, 1)


def test_month_starts():
    assert numeric.month_starts_after(date(2025, 11, 30), 3) == [date(2025, 12, 1), date(2026, 1, 1), date(2026, 2, 1)]


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4], 2.5), ([5, 1, 3, 2, 4], 3.0), ([], 0.0), ([7], 7.0)])
def test_median(spark, values, want):
    assert one(spark, [float(v) for v in values], stats.median) == want


def test_mean_and_spread(spark):
    values = [2.0, 4.0, 4.0, 4.0, 5.0, 5.0, 7.0, 9.0]
    assert one(spark, values, stats.mean) == 5
    assert one(spark, values, stats.stddev) == pytest.approx(2)
    assert one(spark, values, lambda x: stats.stddev_around(x, F.lit(5.0))) == pytest.approx(2)
    assert one(spark, [1.0, 2.0, 3.0], stats.stddev) == pytest.approx(0.8165, abs=1e-4)
    assert one(spark, [], stats.mean) == 0 and one(spark, [3.0], stats.stddev) == 0
    assert one(spark, [-1.0, 1.0], stats.volatility) == 0
    assert one(spark, [25.0, 20.0, 15.0, 10.0], stats.volatility) == pytest.approx(31.25**0.5 / 17.5)


@pytest.mark.parametrize("early, late, want", [(100, 150, 0.5), (100, 50, -0.5), (0, 0, 0), (0, 100, 1)])
def test_growth_rate(spark, early, late, want):
    assert scalar(spark, stats.growth_rate(F.lit(float(early)), F.lit(float(late)))) == want


@pytest.mark.parametrize("changes, want", [([0.1, 0.2, 0.3], "accelerating"), ([0.3, 0.2, 0.1], "decelerating"), ([0.1, 0.12, 0.11], "stable"), ([0.1], "stable")])
def test_momentum(spark, changes, want):
    assert scalar(spark, stats.momentum(F.lit(changes[0]), F.lit(changes[-1]), F.lit(len(changes)))) == want


@pytest.mark.parametrize("growth, spread, want", [(0.5, 0.31, "volatile"), (0.2, 0.1, "upward"), (-0.2, 0.1, "downward"), (0.1, 0.3, "stable")])
def test_direction_looks_at_volatility_first(spark, growth, spread, want):
    assert scalar(spark, stats.direction(F.lit(growth), F.lit(spread))) == want


@pytest.mark.parametrize("spread, points, want", [(0.05, 12, "high"), (0.15, 6, "medium"), (0.3, 6, "low"), (0.05, 2, "low"), (0.2, 3, "medium"), (0.1, 6, "medium")])
def test_confidence(spark, spread, points, want):
    assert scalar(spark, stats.confidence(F.lit(spread), F.lit(points))) == want


@pytest.mark.parametrize("shares, want", [([80.0, 10.0, 5.0, 5.0], 0.655), ([25.0] * 4, 0.25), ([100.0], 1.0), ([], 0.0)])
def test_herfindahl(spark, shares, want):
    assert one(spark, shares, stats.herfindahl) == pytest.approx(want)
