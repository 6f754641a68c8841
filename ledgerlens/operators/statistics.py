"""Statistics of every item at once, from aggregated rows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import stats
from ledgerlens.functions.numeric import exact_sum, js_round, ratio
from ledgerlens.operators.aggregates import with_totals
from ledgerlens.operators.selection import exact_medians


def basic(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, standard deviation (also around 0) and volatility of each group."""
    x = F.col(value)
    return rows.groupBy(key).agg(
        stats.mean(x).alias("mean"), stats.median(x).alias("median"), stats.stddev(x).alias("stddev"), stats.stddev_around(x, F.lit(0.0)).alias("rms"), stats.volatility(x).alias("volatility")
    )


def trend(quarters: DataFrame) -> DataFrame:
    """Direction, growth, momentum and volatility of each item's quarterly averages (rows of long_quarters)."""
    order = Window.partitionBy("item_id").orderBy("idx")
    previous = F.lag("avg_monthly").over(order)
    steps = quarters.withColumn("change", F.when(previous != 0, (F.col("avg_monthly") - previous) / previous))
    moved = F.when(F.col("change").isNotNull(), F.col("idx"))
    found = steps.groupBy("item_id").agg(
        F.min_by("avg_monthly", "idx").alias("first"), F.max_by("avg_monthly", "idx").alias("last"), stats.volatility(F.col("avg_monthly")).alias("volatility"),
        F.min_by("change", moved).alias("c1"), F.max_by("change", moved).alias("cn"), F.count("change").alias("changes"),
    )
    growth = stats.growth_rate(F.col("first"), F.col("last"))
    return found.select("item_id", growth.alias("growth_rate"), "volatility", stats.momentum(F.col("c1"), F.col("cn"), F.col("changes")).alias("momentum"), stats.direction(growth, F.col("volatility")).alias("direction"))


def price_profile(distribution: DataFrame, by_selection: bool = False) -> DataFrame:
    """The columns of `price_stats` and of `discounts`: mean and mode are joined back to the prices, which are then grouped once.

    With `by_selection` the median too is found without a buffer that grows with an item's distinct prices.
    """
    price = F.col("price").cast("double")
    q, pq = F.sum("exact_quantity"), F.sum(F.expr("cast(price * exact_quantity as decimal(38,8))"))
    best = F.max(F.struct("exact_quantity", (-F.col("price")).alias("minus")))
    rows = with_totals(distribution, F.coalesce(F.when(q > 0, ratio(pq, q)), F.lit(0.0)).alias("centre"), (-best["minus"]).alias("mode_price"))
    below = F.col("price") < F.col("mode_price")
    gap = F.expr("cast((mode_price - price) * exact_quantity as decimal(38,8))")
    found = rows.groupBy("item_id").agg(
        F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.first("centre").alias("avg_price"), *([] if by_selection else [F.median(price).alias("median_price")]),
        F.when(F.count("*") <= 1, 0.0).otherwise(F.sqrt(F.avg(F.pow(price - F.col("centre"), F.lit(2))))).alias("std_dev"),
        F.first("mode_price").alias("mode"), F.coalesce(F.sum(F.when(below, F.col("exact_quantity"))), F.lit(0)).alias("low"), F.sum("exact_quantity").alias("total"), F.sum(F.when(below, gap)).alias("gap"),
    )
    if by_selection:
        found = found.join(exact_medians(distribution, "item_id", "price").withColumnRenamed("median", "median_price"), "item_id", "left")
    has = (F.col("low") > 0) & (F.col("total") > 0)
    pct = ratio(F.col("gap"), F.col("mode").cast("double") * F.col("low").cast("double")) * 100
    return found.select(
        "item_id", "min_price", "max_price", "avg_price", "median_price", "std_dev", F.when(F.col("avg_price") == 0, 0.0).otherwise(F.col("std_dev") / F.abs("avg_price") * 100).alias("variance_pct"),
        F.col("mode").cast("double").alias("mode_price"), has.alias("has_discounts"), F.when(has, ratio(F.col("low"), F.col("total"))).otherwise(0.0).alias("discount_frequency"), F.when(has & (F.col("mode") > 0), pct).alias("avg_discount_pct"),
    )


def price_stats(distribution: DataFrame) -> DataFrame:
    """Least and largest price, quantity-weighted mean, median of distinct prices, and their spread around that mean."""
    return price_profile(distribution).select("item_id", "min_price", "max_price", "avg_price", "median_price", "std_dev", "variance_pct")


def discounts(distribution: DataFrame) -> DataFrame:
    """Mode price (most quantity, then the lowest), share of quantity sold below it and the mean discount in percent."""
    return price_profile(distribution).select("item_id", "mode_price", "has_discounts", "discount_frequency", "avg_discount_pct")


def concentration(shares: DataFrame, *more, tops: tuple[int, ...] = (3, 5), by_rank: bool = False) -> DataFrame:
    """Sum of squared shares, and the sum of the largest shares, of each item (rows with share in percent).

    `more` are aggregates to be taken in the same grouping.  With `by_rank` the largest shares are added as doubles, from the largest on,
    else as decimals.
    """
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("share"), "customer_id"))
    # each task keeps the first of an item before they meet, so an item of many customers is not ranked in one task
    first = shares.select("item_id", "customer_id", "share").withColumn("rank", rank).where(F.col("rank") <= max(tops))
    # an item's unknown shares (its total is 0) make its top shares unknown too, its index stays 0
    nth = [F.max(F.when(F.col("rank") == n, F.col("share"))) for n in range(1, max(tops) + 1)]
    top = lambda n: reduce(lambda s, x: s + F.coalesce(x, F.lit(0.0)), nth[:n]) if by_rank else exact_sum(F.when(F.col("rank") <= n, F.col("share")), 18)
    sums = [top(n).alias(f"top_{n}_share") for n in tops]
    whole = shares.groupBy("item_id").agg(stats.herfindahl(F.col("share")).alias("herfindahl"), *more)
    return whole.join(first.groupBy("item_id").agg(*sums), "item_id")


def moving_average_forecast(history: DataFrame, value: str, steps: int) -> DataFrame:
    """Mean of each item's history, repeated: rows (item_id, step, forecast)."""
    means = history.groupBy("item_id").agg(stats.mean(F.col(value)).alias("forecast"))
    return means.select("item_id", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "forecast")


def adjusted(forecast: DataFrame, growth: float | str) -> DataFrame:
    """Forecast times (1 + growth * step); growth is a number or a column's name."""
    rate = F.col(growth) if isinstance(growth, str) else F.lit(growth)
    return forecast.withColumn("adjusted", F.col("forecast") * (1 + rate * F.col("step")))


def days_between_orders() -> Column:
    """Mean days between successive invoice lines, rounded; 0 for fewer than two lines."""
    gap = F.datediff("last_date", "first_date") / (F.col("total_orders") - 1)
    return F.when(F.col("total_orders") < 2, 0.0).otherwise(js_round(gap))


def order_frequency(sizes: DataFrame) -> DataFrame:
    return sizes.select("item_id", days_between_orders().alias("frequency_days"))


def recent_trend(daily: DataFrame) -> DataFrame:
    """Later half of the days with sales against the earlier half, and the largest day."""
    order = Window.partitionBy("item_id").orderBy("issue_date")
    whole = Window.partitionBy("item_id")
    rows = daily.withColumns({"nth": F.row_number().over(order), "n": F.count("*").over(whole)})
    first = F.col("nth") <= F.floor(F.col("n") / 2)
    half = lambda part: F.try_divide(F.sum(F.when(part, F.col("sold"))), F.count_if(part))
    found = rows.groupBy("item_id").agg(F.max("sold").alias("max_daily"), F.sum("sold").alias("sold"), half(first).alias("early"), half(~first).alias("late"))
    label = F.when(F.col("late") > F.col("early") * 1.2, "increasing").when(F.col("late") < F.col("early") * 0.8, "decreasing").otherwise("stable")
    return found.select("item_id", "max_daily", "sold", label.alias("recent_trend"))


def age_in_days(day: str, as_of: date):
    return F.datediff(F.lit(as_of), F.col(day))
