"""The seven reports, each for every item of the catalogue in one job.

Every report starts from the items, so an item without sales has a row of zeros and nulls.
"""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import stats
from ledgerlens.functions.numeric import js_round, month_starts_after, ratio, trailing_months
from ledgerlens.operators import aggregates as agg
from ledgerlens.operators import facts, matching
from ledgerlens.operators import statistics as st


def _for_all(items: DataFrame, *parts: DataFrame) -> DataFrame:
    rows = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"))
    for part in parts:
        rows = rows.join(part, "item_id", "left")
    return rows


def _or(column: str, default) -> F.Column:
    return F.coalesce(column, F.lit(default)).alias(column)


def of_items(sales: DataFrame, items: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sales and items of the wanted ids (column id) alone: every report takes them as it takes whole tables."""
    return sales.join(wanted.select(F.col("id").alias("item_id")), "item_id", "left_semi"), items.join(wanted.select("id"), "id", "left_semi")


def of_item(sales: DataFrame, items: DataFrame, item_id) -> tuple[DataFrame, DataFrame]:
    """Sales and items of one id; the filter reaches the scans."""
    return sales.where(F.col("item_id") == item_id), items.where(F.col("id") == item_id)


def item_sales(sales: DataFrame, items: DataFrame, as_of: date, months: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    sums = [f"{c}_{n}" for n in months for c in ("sold", "revenue")]
    rows = facts.catalogue(items).join(agg.item_overview(sales, as_of, months), "item_id", "left")
    return rows.select("item_id", "item_name", "stock", "latest_estimate", "latest_purchase", *[_or(c, 0.0) for c in sums])


def item_sales_with_freshness(sales: DataFrame, items: DataFrame, as_of: date, state: dict | None, now: int, months: tuple[int, ...] = (3, 6, 12), threshold: int = 3600) -> DataFrame:
    """The item sales with the time of the store's last sync (unknown before the first) and whether that is too long ago."""
    last = None if state is None else datetime.fromtimestamp(state["lastSync"], UTC)
    said = "unknown" if last is None else f"{last:%Y-%m-%dT%H:%M:%S}.000Z"
    stale = state is None or state["lastSync"] < now - threshold
    return item_sales(sales, items, as_of, months).withColumns({"last_sync": F.lit(said), "stale": F.lit(stale)})


def item_sales_periods(sales: DataFrame, as_of: date) -> DataFrame:
    return agg.long_periods(agg.period_totals(sales, as_of))


def trends(sales: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    found = st.trend(agg.long_quarters(agg.quarter_windows(sales, as_of)))
    return _for_all(items, found).select(
        "item_id", "item_name", _or("direction", "stable"), js_round(F.coalesce("growth_rate", F.lit(0.0)), 3).alias("growth_rate"), _or("momentum", "stable"), js_round(F.coalesce("volatility", F.lit(0.0)), 3).alias("volatility")
    )


def trend_periods(sales: DataFrame, as_of: date) -> DataFrame:
    return agg.long_quarters(agg.quarter_windows(sales, as_of)).withColumn("avg_monthly", js_round(F.col("avg_monthly"), 2))


def stock(sales: DataFrame, items: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Cover, status, reorder advice and overstock, unrounded."""
    recent = st.recent_trend(agg.daily_sales(sales, as_of, days))
    rows = facts.catalogue(items).join(recent, "item_id", "left")
    rows = rows.withColumns({"max_daily": F.coalesce("max_daily", F.lit(0.0)), "avg_daily": F.coalesce("sold", F.lit(0.0)) / days, "recent_trend": F.coalesce("recent_trend", F.lit("stable"))})
    rate = F.nullif(F.col("avg_daily"), F.lit(0.0))
    rows = rows.withColumns({"days_of_stock": F.floor(F.col("stock") / rate), "stock_to_sales": F.col("stock") / (rate * 30)})
    d, held = F.col("days_of_stock"), F.col("stock") > 0
    over = (d > 90) & (F.col("recent_trend") == "decreasing")
    by_days = lambda none, few, some, much, fine: F.when(d.isNull(), none).when(d < 14, few).when(d < 30, some).when(over, much).otherwise(fine)
    rows = rows.withColumns(
        {
            "stock_status": by_days(F.when(held, "adequate").otherwise("critical"), "critical", "low", "overstocked", "adequate"),
            "risk_level": by_days(F.when(held, "low").otherwise("high"), "high", "medium", "medium", "low"),
            "should_reorder": F.coalesce(d < 30, F.lit(False)),
            "suggested_qty": F.when(d < 14, F.ceil((30 - d) * F.col("avg_daily"))).when(d < 30, F.ceil((45 - d) * F.col("avg_daily"))),
            "urgency": F.when(d < 14, "immediate").when(d < 30, "soon").when(d < 45, "monitor"),
            "is_overstocked": F.coalesce(over, F.lit(False)),
        }
    )
    excess = F.when(F.col("is_overstocked"), F.greatest(F.lit(0.0), F.col("stock") - F.col("avg_daily") * 90)).otherwise(0.0)
    rows = rows.withColumn("excess_units", excess)
    rows = rows.withColumn("excess_value", F.col("excess_units") * F.coalesce("unit_cost", F.lit(0.0)))
    return rows.withColumn("carrying_cost", F.when(F.col("is_overstocked") & F.col("unit_cost").isNotNull(), F.col("excess_value") * 0.25))


def inventory(sales: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    """Stock report, rounded; days_of_stock is in the text of the advice."""
    rows = stock(sales, items, as_of)
    text = F.concat(F.lit("Only "), F.col("days_of_stock"), F.lit(" days of stock left"))
    return rows.select(
        "item_id", "item_name", "stock", "days_of_stock", js_round(F.col("stock_to_sales"), 2).alias("stock_to_sales"), js_round(F.col("avg_daily"), 2).alias("avg_daily"), "max_daily", "recent_trend", "stock_status", "risk_level",
        "should_reorder", "suggested_qty", "urgency", F.when(F.col("urgency").isNotNull(), text).alias("rationale"), "is_overstocked", js_round(F.col("excess_units")).alias("excess_units"), js_round(F.col("excess_value"), 2).alias("excess_value"), js_round(F.col("carrying_cost"), 2).alias("carrying_cost"),
    )


def pricing(sales: DataFrame, items: DataFrame, as_of: date, by_selection: bool = False) -> DataFrame:
    """Prices of a year; `by_selection` finds medians for items of any number of distinct prices."""
    prices = agg.price_distribution(sales, trailing_months(as_of, 12))
    rows = _for_all(items, st.price_profile(prices, by_selection))
    two = [js_round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("min_price", "max_price", "avg_price", "median_price", "std_dev")]
    return rows.select(
        "item_id", "item_name", *two, js_round(F.coalesce("variance_pct", F.lit(0.0)), 1).alias("variance_pct"), _or("has_discounts", False), js_round(F.col("avg_discount_pct"), 1).alias("avg_discount_pct"), js_round(F.coalesce("discount_frequency", F.lit(0.0)), 3).alias("discount_frequency")
    )


def pricing_distribution(sales: DataFrame, as_of: date) -> DataFrame:
    rows = agg.share_of_total(agg.price_distribution(sales, trailing_months(as_of, 12)), F.col("total_quantity"), 0.0)
    return agg.in_order(rows, "price").select("item_id", js_round(F.col("price"), 2).alias("price"), F.col("total_quantity").alias("quantity"), js_round(F.col("total_revenue"), 2).alias("revenue"), js_round(F.col("share"), 1).alias("frequency_pct"))


def customer_shares(sales: DataFrame, as_of: date) -> DataFrame:
    rows = agg.sales_by_customer(sales, trailing_months(as_of, 12))
    return agg.share_of_total(rows, F.abs("total_revenue"), None)


def customers(sales: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    shares = customer_shares(sales, as_of)
    rows = _for_all(items, st.concentration(shares, *agg.total_sums(), *agg.segment_counts(), by_rank=True).withColumnsRenamed({c: f"{c}_customers" for c in ("large", "medium", "small")}))
    none = F.col("total_customers").isNull()
    top = lambda n: js_round(F.when(none, 0.0).otherwise(F.col(f"top_{n}_share")), 1).alias(f"top_{n}_share")
    return rows.select(
        "item_id", "item_name", _or("total_customers", 0), _or("total_quantity", 0.0), _or("total_revenue", 0.0), top(3), top(5), js_round(F.coalesce("herfindahl", F.lit(0.0)), 3).alias("herfindahl"), _or("large_customers", 0), _or("medium_customers", 0), _or("small_customers", 0)
    )


def customers_top(sales: DataFrame, as_of: date, names: DataFrame | None = None, count: int = 10) -> DataFrame:
    """The first customers of each item by signed revenue, with names if the dimension is given."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("total_revenue"), "customer_id"))
    rows = customer_shares(sales, as_of).withColumn("rank", rank).where(F.col("rank") <= count)
    rows = rows.withColumn("customer_name", F.col("customer_id")) if names is None else facts.with_customer_name(rows, names)
    return rows.select(
        "item_id", F.col("rank").cast("long").alias("rank"), "customer_id", "customer_name", "total_quantity", F.abs("total_revenue").alias("revenue"), "order_count", js_round(F.col("share"), 1).alias("share_pct"), js_round(ratio(F.col("total_quantity"), F.col("order_count")), 2).alias("avg_order_size")
    )


def _history(sales: DataFrame, as_of: date) -> DataFrame:
    months = agg.sales_by_month(sales, trailing_months(as_of, 6))
    q = F.col("total_quantity")
    return months.groupBy("item_id").agg(
        F.count("*").alias("points"), stats.mean(q).alias("mean"), stats.exact_volatility(q).alias("volatility"), F.min_by(q, F.col("month")).alias("first"), F.max_by(q, F.col("month")).alias("last"),
        ratio(F.sum(F.col("total_revenue").cast("decimal(38,8)")), F.sum(q.cast("decimal(38,4)"))).alias("revenue_per_unit"),
    ).withColumn("growth", F.when(F.col("points") >= 2, stats.growth_rate(F.col("first"), F.col("last"))).otherwise(0.0))


def forecast(sales: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    rows = _for_all(items, _history(sales, as_of))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "item_id", "item_name", js_round(zero("mean"), 2).alias("historical_avg"), js_round(zero("growth"), 3).alias("growth_rate"), js_round(zero("volatility"), 3).alias("volatility"), _or("points", 0), stats.confidence(zero("volatility"), F.coalesce("points", F.lit(0))).alias("confidence")
    )


def forecast_months(sales: DataFrame, items: DataFrame, as_of: date, count: int = 3) -> DataFrame:
    """Predicted quantity and revenue of each item in the coming months."""
    months = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(f"{d:%Y-%m}").alias("month")) for i, d in enumerate(month_starts_after(as_of, count), 1)])
    rows = _for_all(items, _history(sales, as_of)).withColumn("next", F.explode(months))
    raw = F.coalesce("mean", F.lit(0.0)) * (1 + F.coalesce("growth", F.lit(0.0)) / 6 * F.col("next.step"))
    rows = rows.withColumn("predicted_quantity", F.greatest(F.lit(0.0), js_round(raw)))
    return rows.select("item_id", "next.month", "predicted_quantity", js_round(F.col("predicted_quantity") * F.coalesce("revenue_per_unit", F.lit(0.0)), 2).alias("predicted_revenue"), stats.confidence(F.coalesce("volatility", F.lit(0.0)), F.coalesce("points", F.lit(0))).alias("confidence"))


def patterns(sales: DataFrame, items: DataFrame, as_of: date, by_selection: bool = False) -> DataFrame:
    """Order sizes and outcomes of a year; `by_selection` as in `pricing`."""
    year = trailing_months(as_of, 12)
    sizes = agg.order_profile(sales, year, by_selection)
    rows = _for_all(items, sizes.withColumn("frequency_days", st.days_between_orders()), matching.outcomes(matching.match_estimates(sales, year), as_of))
    zero = [_or(c, 0) for c in ("total_orders", "small", "medium", "large")]
    two = [js_round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("avg_size", "median_size")]
    # without estimates cycle time and win rate are unknown
    return rows.select("item_id", "item_name", *zero, *two, _or("min_size", 0.0), _or("max_size", 0.0), _or("frequency_days", 0.0), "avg_cycle_days", "median_cycle_days", "created", "converted", "open", "lost", "win_rate")
