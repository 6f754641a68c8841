"""Oracle SQL (DuckDB) of the registered queries of this library, over the same Parquet tables."""

from __future__ import annotations

#: The adapter's tables as common table expressions.
BASE = """
with sales_documents as (
  select 'E' || cast(o_orderkey as varchar) as doc_id, 4 as context_id, o_orderkey as doc_number, cast(o_orderdate as date) as issue_date, 'C' || cast(o_custkey as varchar) as customer_id from orders
  union all
  select 'I' || cast(o_orderkey as varchar), 5, o_orderkey, cast(o_orderdate as date) + cast(o_orderkey * 7 % 45 as integer), 'C' || cast(o_custkey as varchar) from orders where o_orderstatus <> 'O'
  union all
  select 'P' || cast(o_orderkey as varchar), 11, o_orderkey, cast(o_orderdate as date), 'C' || cast(o_custkey as varchar) from orders where o_orderstatus = 'O'),
headers as (select *, cast(epoch(issue_date) as bigint) as modified from sales_documents),
priced as (
  select l_orderkey, l_partkey as item_id, cast(l_quantity as decimal(18,4)) as quantity,
         cast(round(cast(p_retailprice as decimal(12,2)) * (1 - cast(l_discount as decimal(5,2))), 2) as decimal(18,4)) as price
  from lineitem join part on l_partkey = p_partkey),
item_lines as (
  select item_id, 'E' || cast(l_orderkey as varchar) as doc_id, quantity, price from priced join orders on l_orderkey = o_orderkey
  union all
  select item_id, case when o_orderstatus = 'O' then 'P' else 'I' end || cast(l_orderkey as varchar), quantity, price from priced join orders on l_orderkey = o_orderkey),
items as (
  select p_partkey as id, p_name as name, p_type as description, 'SKU-' || cast(p_partkey as varchar) as sku, p_type || '/' || p_brand as category_id, cast(p_size as double) as quantity,
         case when p_partkey % 10 <> 0 then cast(round(cast(p_retailprice as decimal(12,2)) * 0.6, 2) as double) end as cost, cast(cast(p_retailprice as decimal(12,2)) as double) as price, p_partkey * 1000 as modified
  from part),
accounts as (
  select 'C' || cast(c_custkey as varchar) as id, 2 as context_id, c_name as name, 'c' || cast(c_custkey as varchar) || '@example.com' as office_email, c_custkey * 1000 as modified from customer
  union all
  select 'S' || cast(s_suppkey as varchar), 10, s_name, null, s_suppkey * 1000 from supplier),
categories as (
  select p_type || '/' || p_brand as id, p_brand as name, p_type as parent_id, count(*) as item_count from part group by p_type, p_brand
  union all
  select p_type, p_type, null, count(*) from part group by p_type),
locations as (select cast(n_nationkey as bigint) as id, n_name as name, left(n_name, 3) as short_name from nation),
sales as (
  select l.item_id, l.doc_id, d.context_id, d.doc_number, d.issue_date, d.customer_id, l.quantity, l.price, cast(l.quantity * l.price as decimal(38,8)) as amount
  from item_lines l join sales_documents d on l.doc_id = d.doc_id),
year_sales as (select * from sales where context_id = 5 and issue_date between date '2000-08-01' and date '2001-08-01'),
all_items as (select id as item_id, name as item_name from items)
"""

ROUND = "floor(({0}) * {1} + 0.5) / {1}"


def r(value: str, places: int = 0) -> str:
    return ROUND.format(value, float(10**places))


MONTHS = [(3, "2001-05-01"), (6, "2001-02-01"), (12, "2000-08-01")]
QUARTERS = [("2000-08-01", "2000-11-01"), ("2000-11-01", "2001-02-01"), ("2001-02-01", "2001-05-01"), ("2001-05-01", "2001-08-01")]


def _sum(value: str, test: str) -> str:
    return f"coalesce(cast(sum(case when {test} then {value} end) as double), 0)"


_PERIODS = ", ".join(f"{_sum('abs(quantity)', t)} as sold_{n}, abs({_sum('amount', t)}) as revenue_{n}" for n, s in MONTHS for t in [f"issue_date between date '{s}' and date '2001-08-01'"])
_PERIOD_CTE = f", totals as (select item_id, {_PERIODS} from year_sales group by item_id)"
_LATEST = "max(case when context_id = 4 then issue_date end) as latest_estimate, max(case when context_id = 5 then issue_date end) as latest_invoice, max(case when context_id = 11 then issue_date end) as latest_purchase"
_QUARTER_CTE = ", quarters as (" + " union all ".join(
    f"select item_id, {i} as idx, '{n}' as period, {_sum('abs(quantity)', t)} as sold, abs({_sum('amount', t)}) as revenue, {_sum('abs(quantity)', t)} / 3 as avg_monthly from year_sales group by item_id"
    for i, (n, (a, b)) in enumerate(zip(("months_1_3", "months_4_6", "months_7_9", "months_10_12"), QUARTERS), 1)
    for t in [f"issue_date between date '{a}' and date '{b}'"]
) + ")"
_VOL = "case when coalesce(avg({0}), 0) = 0 then 0.0 else case when count(*) <= 1 then 0.0 else stddev_pop({0}) end / abs(sum({0}) / count({0})) end"
_GROWTH = "case when {0} = 0 then case when {1} > 0 then 1.0 else 0.0 end else ({1} - {0}) / {0} end"
_TREND_CTE = _QUARTER_CTE + f""",
steps as (select *, lag(avg_monthly) over (partition by item_id order by idx) as prev from quarters),
changes as (select *, case when prev <> 0 then (avg_monthly - prev) / prev end as change from steps),
trend0 as (
  select item_id, min_by(avg_monthly, idx) as f, max_by(avg_monthly, idx) as l, {_VOL.format('avg_monthly')} as volatility,
         min_by(change, idx) filter (change is not null) as c1, max_by(change, idx) filter (change is not null) as cn, count(change) as n
  from changes group by item_id),
trend1 as (select *, {_GROWTH.format('f', 'l')} as growth_rate, case when n >= 2 then (cn - c1) / (n - 1) else 0.0 end as step from trend0),
trend as (
  select item_id, growth_rate, volatility, case when step > 0.05 then 'accelerating' when step < -0.05 then 'decelerating' else 'stable' end as momentum,
         case when volatility > 0.3 then 'volatile' when growth_rate > 0.1 then 'upward' when growth_rate < -0.1 then 'downward' else 'stable' end as direction
  from trend1)"""
_PRICE_CTE = """, prices as (
  select item_id, price, sum(abs(quantity)) as q, cast(sum(abs(quantity)) as double) as total_quantity, cast(sum(amount) as double) as total_revenue from year_sales group by item_id, price)"""
_STATS_CTE = _PRICE_CTE + """,
centred as (
  select *, coalesce(case when sum(q) over w > 0 then cast(sum(cast(price * q as decimal(38,8))) over w as double) / cast(sum(q) over w as double) end, 0.0) as centre from prices window w as (partition by item_id)),
price_stats as (
  select *, case when avg_price = 0 then 0.0 else std_dev / abs(avg_price) * 100 end as variance_pct from (
    select item_id, min(cast(price as double)) as min_price, max(cast(price as double)) as max_price, min(centre) as avg_price, median(cast(price as double)) as median_price,
           case when count(*) <= 1 then 0.0 else sqrt(avg(pow(cast(price as double) - centre, 2))) end as std_dev from centred group by item_id))"""
_DISCOUNT_CTE = _STATS_CTE + """,
moded as (select *, first_value(price) over (partition by item_id order by q desc, price) as mode_price from prices),
disc0 as (
  select item_id, min(mode_price) as m, coalesce(sum(case when price < mode_price then q end), 0) as low, sum(q) as total,
         sum(case when price < mode_price then cast((mode_price - price) * q as decimal(38,8)) end) as gap from moded group by item_id),
discounts as (
  select item_id, cast(m as double) as mode_price, low > 0 and total > 0 as has_discounts, case when low > 0 and total > 0 then cast(low as double) / cast(total as double) else 0.0 end as discount_frequency,
         case when low > 0 and total > 0 and m > 0 then cast(gap as double) / (cast(m as double) * cast(low as double)) * 100 end as avg_discount_pct from disc0)"""
_CUSTOMER_CTE = """, by_customer as (
  select item_id, customer_id, coalesce(cast(sum(abs(quantity)) as double), 0) as total_quantity, coalesce(cast(sum(amount) as double), 0) as total_revenue, count(distinct doc_id) as order_count from year_sales group by item_id, customer_id),
shares as (
  select *, abs(total_revenue) / nullif(sum(abs(total_revenue)) over (partition by item_id), 0) * 100 as share from by_customer),
ranked as (select *, row_number() over (partition by item_id order by share desc, customer_id) as rk from shares)"""
_MONTH_CTE = """, months as (
  select item_id, strftime(issue_date, '%Y-%m') as month, cast(sum(abs(quantity)) as double) as total_quantity, cast(sum(amount) as double) as total_revenue
  from sales where context_id = 5 and issue_date between date '2001-02-01' and date '2001-08-01' group by item_id, strftime(issue_date, '%Y-%m'))"""
_HISTORY_CTE = _MONTH_CTE + f""",
history0 as (
  select item_id, count(*) as points, sum(total_quantity) / count(*) as mean, {_VOL.format('total_quantity')} as volatility, min_by(total_quantity, month) as f, max_by(total_quantity, month) as l,
         cast(sum(cast(total_revenue as decimal(38,8))) as double) / nullif(cast(sum(cast(total_quantity as decimal(38,4))) as double), 0) as rpu from months group by item_id),
history as (select *, case when points >= 2 then {_GROWTH.format('f', 'l')} else 0.0 end as growth from history0)"""
_CONF = "case when coalesce(volatility, 0) < 0.1 and coalesce(points, 0) >= 6 then 'high' when coalesce(volatility, 0) <= 0.2 and coalesce(points, 0) >= 3 then 'medium' else 'low' end"
_DAILY_CTE = """, daily as (
  select item_id, issue_date, cast(sum(abs(quantity)) as double) as sold from sales where context_id = 5 and issue_date between date '2001-05-03' and date '2001-08-01' group by item_id, issue_date)"""
_RECENT_CTE = _DAILY_CTE + """,
halves as (select *, row_number() over (partition by item_id order by issue_date) as nth, count(*) over (partition by item_id) as n from daily),
recent0 as (
  select item_id, max(sold) as max_daily, sum(sold) as sold, sum(sold) filter (nth <= n // 2) / nullif(count(*) filter (nth <= n // 2), 0) as early,
         sum(sold) filter (nth > n // 2) / nullif(count(*) filter (nth > n // 2), 0) as late from halves group by item_id),
recent as (select item_id, max_daily, sold, case when late > early * 1.2 then 'increasing' when late < early * 0.8 then 'decreasing' else 'stable' end as recent_trend from recent0)"""
_STOCK_CTE = _RECENT_CTE + """,
stock0 as (
  select i.id as item_id, i.name as item_name, coalesce(i.quantity, 0) as stock, nullif(i.cost, 0) as unit_cost, coalesce(max_daily, 0.0) as max_daily, coalesce(sold, 0.0) / 90 as avg_daily, coalesce(recent_trend, 'stable') as recent_trend
  from items i left join recent r on r.item_id = i.id),
stock1 as (select *, cast(floor(stock / nullif(avg_daily, 0)) as bigint) as d, stock / (nullif(avg_daily, 0) * 30) as stock_to_sales from stock0),
stock2 as (select *, coalesce(d > 90 and recent_trend = 'decreasing', false) as is_overstocked from stock1),
stock3 as (
  select *, case when d is null then case when stock > 0 then 'adequate' else 'critical' end when d < 14 then 'critical' when d < 30 then 'low' when is_overstocked then 'overstocked' else 'adequate' end as stock_status,
         case when d is null then case when stock > 0 then 'low' else 'high' end when d < 14 then 'high' when d < 30 then 'medium' when is_overstocked then 'medium' else 'low' end as risk_level,
         coalesce(d < 30, false) as should_reorder, cast(case when d < 14 then ceil((30 - d) * avg_daily) when d < 30 then ceil((45 - d) * avg_daily) end as bigint) as suggested_qty,
         case when d < 14 then 'immediate' when d < 30 then 'soon' when d < 45 then 'monitor' end as urgency,
         case when is_overstocked then greatest(0.0, stock - avg_daily * 90) else 0.0 end as excess_units from stock2),
stock as (select *, excess_units * coalesce(unit_cost, 0.0) as excess_value, case when is_overstocked and unit_cost is not null then excess_units * coalesce(unit_cost, 0.0) * 0.25 end as carrying_cost from stock3)"""
_MATCH_CTE = """, invoices as (
  select item_id, doc_number, customer_id, doc_id as invoice_id, issue_date as invoice_date from (
    select *, row_number() over (partition by item_id, doc_number, customer_id order by issue_date desc, doc_id) as nth from year_sales) where nth = 1),
matched as materialized (
  select e.item_id, e.doc_number, e.customer_id, e.doc_id, e.issue_date, e.quantity, e.price, i.invoice_id, i.invoice_date
  from (select * from sales where context_id = 4 and issue_date between date '2000-08-01' and date '2001-08-01') e left join invoices i using (item_id, doc_number, customer_id))"""
_CYCLE = f"select item_id, {r('coalesce(cast(sum(abs(invoice_date - issue_date)) as double) / nullif(count(invoice_date), 0), 0)', 1)} as avg_cycle_days, {r('coalesce(median(cast(abs(invoice_date - issue_date) as double)), 0)', 1)} as median_cycle_days from matched group by item_id"
_WIN = f"""select *, {r('cast(converted as double) / created', 3)} as win_rate from (
  select item_id, count(*) as created, count(distinct case when invoice_id is not null then doc_id end) as converted,
         count(*) filter (invoice_id is null and date '2001-08-01' - issue_date <= 30) as open, count(*) filter (invoice_id is null and date '2001-08-01' - issue_date > 30) as lost from matched group by item_id)"""
_SIZES = "select item_id, count(*) as total_orders, cast(sum(quantity) as double) / count(quantity) as avg_size, median(cast(quantity as double)) as median_size, cast(min(quantity) as double) as min_size, cast(max(quantity) as double) as max_size, min(issue_date) as first_date, max(issue_date) as last_date from year_sales group by item_id"
_FREQ = f"case when total_orders < 2 then 0.0 else {r('cast(last_date - first_date as double) / (total_orders - 1)')} end as frequency_days"
_SPREAD = "select y.item_id, count(*) filter (y.quantity < avg_size / 2) as small, count(*) filter (y.quantity >= avg_size / 2 and y.quantity <= avg_size * 2) as medium, count(*) filter (y.quantity > avg_size * 2) as large from (select item_id, cast(quantity as double) as quantity from year_sales) y join sizes using (item_id) group by y.item_id"
_LINE = "item_id, doc_id, cast(quantity as double) as quantity, cast(price as double) as price"
_HEAD = "doc_id, context_id, doc_number, issue_date, customer_id, modified"


def oracle_sql() -> dict[str, str]:
    found = {
        # lookups and filters
        "documents_by_context": f"select {_HEAD} from headers where context_id = 5",
        "document_by_id": f"select {_HEAD} from headers where doc_number % 50 = 0",
        "lines_of_document": f"select {_LINE} from item_lines where cast(substr(doc_id, 2) as bigint) % 50 = 0",
        "modified_since": f"select {_HEAD} from headers where modified > 990000000",
        "lines_for_period": f"select {_LINE}, issue_date from year_sales",
        "sales_by_period": "select item_id, issue_date, cast(quantity as double) as quantity, cast(price as double) as price from year_sales",
        "order_patterns": f"select {_LINE}, issue_date, customer_id, context_id, doc_number from sales where context_id in (4, 5) and issue_date between date '2000-08-01' and date '2001-08-01'",
        "list_items": "select id, name, sku, category_id, quantity, cost, price, modified from items where (lower(name) like '%1%' or lower(description) like '%1%' or lower(sku) like '%1%') and modified > 50000",
        "list_items_page": "select id, name, sku, category_id, quantity, cost, price, modified from items order by id limit 25 offset 50",
        "list_customers": "select * from accounts where context_id = 2 and (lower(name) like '%7%' or lower(office_email) like '%7%') and modified > 20000",
        "list_documents": f"select {_HEAD} from headers where context_id = 5 and cast(doc_number as varchar) like '%12%' and modified > 900000000",
        "list_categories": "select * from categories order by id limit 20 offset 20",
        "list_locations": "select * from locations order by id limit 10 offset 10",
        "get_by_id": "select id, name, sku, category_id, quantity, cost, price, modified from items where id % 100 = 7",
        "get_items_by_id": "select id, name, sku, category_id, quantity, cost, price, modified from items where id % 50 = 0",
        "get_customers_by_id": "select * from accounts where cast(substr(id, 2) as bigint) % 50 = 0",
        "get_categories_by_id": "select * from categories where id in (select category_id from items where id % 50 = 0)",
        "get_locations_by_id": "select * from locations where id % 50 = 0",
        "valid_context": "select doc_id, case when doc_number % 7 = 0 then null when doc_number % 11 = 0 then 'x' when doc_number % 13 = 0 then '8' else cast(context_id as varchar) end as context_id, case when doc_number % 7 = 0 then 'context_id is required' when doc_number % 11 = 0 then 'context_id is not a number' when doc_number % 13 = 0 then 'context_id is not valid' end as reason from headers",
        "validate_customers": "select id, case when n % 7 = 0 then 'context_id is required' when n % 11 = 0 then 'context_id is not a number' when n % 13 = 0 then 'context_id is not valid' end as reason from (select id, cast(substr(id, 2) as bigint) as n from accounts)",
        # joins
        "join_lines_documents": f"select {_LINE}, context_id, doc_number, issue_date, customer_id from sales",
        "join_item_dim": "select l.item_id, l.n, i.name as item_name, coalesce(i.quantity, 0) as stock, nullif(i.cost, 0) as unit_cost, case when i.price > 0 then i.price else 0 end as list_price from (select item_id, count(*) as n from item_lines group by item_id) l left join items i on i.id = l.item_id",
        "join_customer_names": "select d.customer_id, d.n, coalesce(a.name, d.customer_id) as customer_name from (select customer_id, count(*) as n from headers group by customer_id) d left join accounts a on a.id = d.customer_id",
        "orphan_lines": f"select {_LINE} from item_lines where doc_id not in (select doc_id from headers where doc_number % 11 <> 0)",
        "match_estimate_invoice": _MATCH_CTE + "select item_id, doc_number, customer_id, doc_id, issue_date, invoice_id, invoice_date from matched",
        "estimates_converted": _MATCH_CTE + "select item_id, doc_id, invoice_id from matched where invoice_id is not null",
        "estimates_unconverted": _MATCH_CTE + "select item_id, doc_id, issue_date from matched where invoice_id is null",
        # aggregates
        "count_documents": "select count(*) as n from headers",
        "count_lines": "select count(*) as n from item_lines",
        "latest_document_date": f"select item_id, {_LATEST} from sales group by item_id",
        "price_distribution": _PRICE_CTE + "select item_id, cast(price as double) as price, total_quantity, total_revenue from prices",
        "sales_by_customer": _CUSTOMER_CTE + "select item_id, customer_id, total_quantity, total_revenue, order_count from by_customer",
        "sales_by_month": _MONTH_CTE + "select item_id, month, total_quantity, total_revenue from months",
        "period_totals": _PERIOD_CTE + "select * from totals",
        "quarter_windows": _QUARTER_CTE + "select item_id, idx, period, sold, revenue, avg_monthly from quarters",
        "window_overlap": _QUARTER_CTE + "select idx, sum(sold) as sold from quarters group by idx",
        "daily_sales": _DAILY_CTE + "select item_id, issue_date, sold from daily",
        "item_totals": _CUSTOMER_CTE + f"select item_id, count(*) as total_customers, sum(total_quantity) as total_quantity, {r('sum(abs(total_revenue))', 4)} as total_revenue from by_customer group by item_id",
        "share_of_total": _CUSTOMER_CTE + f"select item_id, customer_id, {r('share', 6)} as share from shares",
        "order_size_stats": f", sizes as ({_SIZES}) select item_id, total_orders, avg_size, median_size, min_size, max_size, first_date, last_date from sizes",
        "size_distribution": f", sizes as ({_SIZES}) {_SPREAD}",
        "customer_segments": _CUSTOMER_CTE + "select item_id, count(*) filter (share > 10) as large, count(*) filter (share between 3 and 10) as medium, count(*) filter (share < 3) as small from shares group by item_id",
        "win_loss_counts": _MATCH_CTE + f"select item_id, created, converted, open, lost from ({_WIN})",
        # statistics
        "stat_basic": f"select item_id, {r('avg(q)', 6)} as mean, {r('median(q)', 6)} as median, {r('case when count(q) <= 1 then 0.0 else stddev_pop(q) end', 6)} as stddev, {r('case when count(q) <= 1 then 0.0 else sqrt(avg(q * q)) end', 6)} as rms, {r(_VOL.format('q'), 6)} as volatility from (select item_id, cast(quantity as double) as q from year_sales) group by item_id",
        "stat_growth_rate": _HISTORY_CTE + f"select item_id, {r(_GROWTH.format('f', 'l'), 6)} as growth from history",
        "stat_momentum": _TREND_CTE + "select item_id, momentum from trend",
        "detect_trend": _TREND_CTE + f"select item_id, direction, {r('growth_rate', 6)} as growth_rate, {r('volatility', 6)} as volatility, momentum from trend",
        "price_stats": _STATS_CTE + f"select item_id, min_price, max_price, {r('avg_price', 6)} as avg_price, median_price, {r('std_dev', 6)} as std_dev, {r('variance_pct', 6)} as variance_pct from price_stats",
        "detect_discounts": _DISCOUNT_CTE + f"select item_id, mode_price, has_discounts, {r('discount_frequency', 6)} as discount_frequency, {r('avg_discount_pct', 6)} as avg_discount_pct from discounts",
        "herfindahl": _CUSTOMER_CTE + f"select item_id, {r('sum(pow(share / 100, 2))', 6)} as herfindahl from shares group by item_id",
        "top_share": _CUSTOMER_CTE + f"select item_id, {r('sum(case when rk <= 3 then share end)', 6)} as top_3_share, {r('sum(case when rk <= 5 then share end)', 6)} as top_5_share from ranked group by item_id",
        "forecast_moving_average": _HISTORY_CTE + f"select item_id, cast(s as integer) as step, {r('mean', 6)} as forecast from history, unnest(generate_series(1, 3)) as g(s)",
        "trend_adjustment": _HISTORY_CTE + f"select item_id, cast(s as integer) as step, {r('mean', 6)} as forecast, {r('mean * (1 + 0.1 * s)', 6)} as adjusted from history, unnest(generate_series(1, 3)) as g(s)",
        "confidence": _HISTORY_CTE + f"select item_id, {_CONF} as confidence from history",
        "days_between": _MATCH_CTE + "select item_id, doc_id, cast(abs(invoice_date - issue_date) as integer) as days from matched where invoice_id is not null",
        "days_since": _MATCH_CTE + "select item_id, doc_id, cast(date '2001-08-01' - issue_date as integer) as days from matched where invoice_id is null",
        "order_frequency": f", sizes as ({_SIZES}) select item_id, {_FREQ} from sizes",
        "cycle_time": _MATCH_CTE + _CYCLE,
        "win_rate": _MATCH_CTE + _WIN,
        "recent_trend": _RECENT_CTE + "select item_id, max_daily, sold, recent_trend from recent",
        "stock_cover": _STOCK_CTE + f"select item_id, d as days_of_stock, {r('stock_to_sales', 6)} as stock_to_sales, {r('avg_daily', 6)} as avg_daily from stock",
        "stock_status": _STOCK_CTE + "select item_id, stock_status, risk_level from stock",
        "reorder_recommendation": _STOCK_CTE + "select item_id, should_reorder, suggested_qty, urgency from stock",
        "overstock": _STOCK_CTE + f"select item_id, is_overstocked, {r('excess_units', 4)} as excess_units, {r('excess_value', 4)} as excess_value, {r('carrying_cost', 4)} as carrying_cost from stock",
        "revenue_per_unit": _HISTORY_CTE + f"select item_id, {r('rpu', 6)} as revenue_per_unit from history",
        "top_customers": _CUSTOMER_CTE + "select item_id, customer_id, rk from (select *, row_number() over (partition by item_id order by total_revenue desc, customer_id) as rk from by_customer) where rk <= 10",
        # tables
        "upsert_documents": "select doc_id, context_id, doc_number, issue_date, case when doc_number % 10 = 0 and context_id = 5 then 'C0' else customer_id end as customer_id, case when doc_number % 10 = 0 and context_id = 5 then modified + 2 else modified end as modified from headers",
        "replace_lines": "select item_id, doc_id, cast(quantity as double) * case when doc_id like 'I%0' then 2 else 1 end as quantity, cast(price as double) as price from item_lines",
        "append_lines": f"select {_LINE} from item_lines union all select {_LINE} from item_lines where doc_id like 'P%'",
        "delete_documents_cascade": "select 'documents' as kept, count(*) as n from headers where doc_number % 7 <> 0 union all select 'lines', count(*) from item_lines where cast(substr(doc_id, 2) as bigint) % 7 <> 0",
        "delete_lines": f"select {_LINE} from item_lines where cast(substr(doc_id, 2) as bigint) % 7 <> 0",
        "backfill_missing_lines": "select doc_id, count(*) as n_lines from item_lines group by doc_id",
        "normalize_documents": f"select {_HEAD} from headers",
        "flatten_lines": "select cast(item_id as varchar) as item_id, doc_id, cast(quantity as double) as quantity, cast(price as double) as price from item_lines where cast(quantity as integer) % 5 <> 0",
        "validate_documents": "select h.doc_id, case when h.doc_number % 13 = 0 then 'customer_id is required' when h.doc_number % 17 = 0 then 'issue_date is required' when l.doc_id is null then 'at least one line is required' end as reason from headers h left join (select distinct doc_id from item_lines) l on l.doc_id = h.doc_id",
        "sales_by_month_sorted": _MONTH_CTE + "select item_id, row_number() over (partition by item_id order by month) as nth, month, total_quantity from months",
        "price_distribution_sorted": _PRICE_CTE + "select item_id, row_number() over (partition by item_id order by price) as nth, cast(price as double) as price, total_quantity from prices",
        "sync_delta_documents": "select doc_id, context_id, doc_number, issue_date, case when doc_number % 3 = 0 then 'C-new' else customer_id end as customer_id, case when doc_number % 3 = 0 or doc_number % 5 = 0 then 2000001000 else modified end as modified from headers where doc_number in (select l_orderkey from priced)",
        "sync_delta_lines": "select cast(item_id as varchar) as item_id, doc_id, cast(quantity as double) * case when cast(substr(doc_id, 2) as bigint) % 3 = 0 then 2 else 1 end as quantity, cast(price as double) as price from item_lines",
        "sync_delta_state": """, d as (select doc_number as n, count(*) as docs from headers where doc_number in (select l_orderkey from priced) group by doc_number),
l as (select cast(substr(doc_id, 2) as bigint) as n, count(*) as lines from item_lines group by n), b as (select * from d join l using (n))
select 'full' as type, cast(sum(docs) as bigint) as documents_processed, cast(sum(lines) as bigint) as lines_processed, 0 as documents_deleted, 2000000000::bigint as "lastSync", 2000000000::bigint as "lastFullSync", cast(sum(docs) as bigint) as "documentCount", cast(sum(lines) as bigint) as "itemDocumentCount", 'main shop' as "accountName", 1 as "schemaVersion" from b where n % 5 <> 0
union all
select 'delta', cast(sum(docs) filter (n % 5 = 0 or n % 3 = 0) as bigint), cast(sum(lines) filter (n % 5 = 0 or n % 3 = 0) as bigint), 0, 2000002000, 2000000000, cast(sum(docs) as bigint), cast(sum(lines) as bigint), 'main shop', 1 from b""",
        "account_stores": "select id, regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g') as store from accounts",
        "period_lists": "select id, cast(2 as bigint) as count, cast(cast(quantity as integer) as varchar) || '/' || cast(id as varchar) as numbers from items",
        "customer_feed": """select id, context_id, case when id like '%3' then 'renamed' else name end as name, cast(null as varchar) as reason from accounts where id not like '%9'
union all select 'N' || id, case when n % 60 = 20 then 4 when n % 60 = 40 then 8 end, name, case when n % 60 = 20 then 'context_id is not valid' when n % 60 = 0 then 'context_id is required' end
from (select *, cast(substr(id, 2) as bigint) as n from accounts where id like 'C%') where n % 20 = 0""",
        "document_feed": """, q as (select doc_id, count(*) as n_lines, cast(sum(quantity) as double) as quantity from item_lines group by doc_id),
h as (select h.doc_id, h.doc_number as n, h.customer_id, h.issue_date, coalesce(n_lines, 0) as n_lines, coalesce(quantity, 0) as quantity from headers h left join q using (doc_id)),
made as (select *, case when n % 30 = 0 then 'customer_id is required' when n % 40 = 0 or n_lines = 0 then 'at least one line is required' end as reason from h where n % 10 = 0)
select doc_id, case when n % 10 = 1 then 'C1' else customer_id end as customer_id, issue_date, n_lines, quantity * case when n % 10 = 1 then 2 else 1 end as quantity, cast(null as varchar) as reason from h where n % 10 <> 2
union all
select 'N' || doc_id, case when n % 30 <> 0 then customer_id end, issue_date, case when n % 40 = 0 then 0 else n_lines end, case when reason is null then quantity else 0 end, reason from made""",
        "report_item_sales_fresh": _PERIOD_CTE + f", latest as (select item_id, {_LATEST} from sales group by item_id) select a.item_id, a.item_name, coalesce(i.quantity, 0) as stock, latest_estimate, latest_purchase, " + ", ".join(f"coalesce(sold_{n}, 0) as sold_{n}, coalesce(revenue_{n}, 0) as revenue_{n}" for n, _ in MONTHS if n != 6) + ", '2001-07-31T23:59:00.000Z' as last_sync, false as stale from all_items a join items i on i.id = a.item_id left join latest using (item_id) left join totals using (item_id)",
        "report_item_sales_of_items": _PERIOD_CTE + f", latest as (select item_id, {_LATEST} from sales group by item_id) select a.item_id, a.item_name, coalesce(i.quantity, 0) as stock, latest_estimate, latest_purchase, " + ", ".join(f"coalesce(sold_{n}, 0) as sold_{n}, coalesce(revenue_{n}, 0) as revenue_{n}" for n, _ in MONTHS) + " from all_items a join items i on i.id = a.item_id left join latest using (item_id) left join totals using (item_id) where a.item_id % 50 = 0",
        "sync_delta": f"select {_HEAD} from headers",
        "freshness": "select count(*) as documentCount, max(modified) < 996624000 - 3600 as stale from headers",
        "table_status": "select '2001-07-31T23:00:00.000Z' as last_sync, count(*) as documents, 'FRESH' as status from headers",
        "apply_item_changes": "select id, case when id % 4 = 1 then 'renamed ' || cast(id as varchar) else name end as name, case when id % 8 = 1 then 5.0 else price end as price from items where id % 9 <> 0 union all select id + 100000000, 'new', 1.0 from items where id % 50 = 0",
        "apply_customer_changes": "select id, context_id, case when id like '%3' then 'renamed' else name end as name from accounts where id not like '%9'",
        "apply_document_changes": "select doc_id, case when doc_number % 4 = 1 then 'C1' else customer_id end as customer_id, issue_date from headers where doc_number % 9 <> 0",
        "apply_category_changes": "select id, case when parent_id is null then 'top' else name end as name, parent_id from categories where item_count > 1",
        "src_items": "select id, name, sku, category_id, quantity, cost, price from items",
        "src_customers": "select id, context_id, name, office_email from accounts",
        "src_categories": "select id, name, parent_id, item_count from categories",
        "src_locations": "select id, name, short_name from locations",
        "src_documents": "select h.doc_id as id, h.context_id, h.doc_number as document_number, h.customer_id, count(l.doc_id) as n_lines from headers h left join item_lines l on l.doc_id = h.doc_id group by all",
        "read_change_json": "select id, name from items",
        # reports
        "report_item_sales": _PERIOD_CTE + f", latest as (select item_id, {_LATEST} from sales group by item_id) select a.item_id, a.item_name, coalesce(i.quantity, 0) as stock, latest_estimate, latest_purchase, " + ", ".join(f"coalesce(sold_{n}, 0) as sold_{n}, coalesce(revenue_{n}, 0) as revenue_{n}" for n, _ in MONTHS) + " from all_items a join items i on i.id = a.item_id left join latest using (item_id) left join totals using (item_id)",
        "report_item_sales_periods": _PERIOD_CTE + " union all ".join(f"select item_id, {n} as months, sold_{n} as sold, revenue_{n} as revenue from totals" for n, _ in MONTHS),
        "report_trends": _TREND_CTE + f"select item_id, item_name, coalesce(direction, 'stable') as direction, {r('coalesce(growth_rate, 0)', 3)} as growth_rate, coalesce(momentum, 'stable') as momentum, {r('coalesce(volatility, 0)', 3)} as volatility from all_items left join trend using (item_id)",
        "write_json": _TREND_CTE + f"select item_id, item_name, coalesce(direction, 'stable') as direction, {r('coalesce(growth_rate, 0)', 3)} as growth_rate, coalesce(momentum, 'stable') as momentum, {r('coalesce(volatility, 0)', 3)} as volatility from all_items left join trend using (item_id)",
        "sync_state": "select cast(996620400 as bigint) as lastSync, cast(996620400 as bigint) as lastFullSync, (select count(*) from headers) as documentCount, (select count(*) from item_lines) as itemDocumentCount, 'main' as accountName, 1 as schemaVersion",
        "sync_full": f"select {_HEAD} from headers where doc_number in (select l_orderkey from priced)",
        "median_by_selection": "select item_id, cast(median(cast(quantity as double)) as double) as median_quantity, cast(median(cast(price as double)) as double) as median_price from sales group by item_id",
        "list_documents_distant_page": "select doc_number * 20 + context_id as place, doc_id, issue_date from headers order by place limit 25 offset ((select count(*) from headers) // 50 - 1) * 25",
        "list_items_after": "select id, name from items where id > 40 order by id limit 30",
        "join_bucketed_lines": "select item_id, doc_id, cast(quantity as double) as quantity, cast(price as double) as price, context_id, customer_id from sales",
        "sync_removals": "select h.doc_id, h.customer_id, count(*) as n_lines from headers h join item_lines l on l.doc_id = h.doc_id where h.doc_number % 7 <> 0 group by h.doc_id, h.customer_id",
        "stored_documents_by_id": "select h.doc_id, h.issue_date, h.customer_id, count(*) as n_lines, cast(sum(quantity) as double) as quantity from headers h join item_lines l on l.doc_id = h.doc_id where h.doc_number % 50 = 0 group by h.doc_id, h.issue_date, h.customer_id",
        "stream_ingest_documents": f"select {_HEAD} from headers where doc_number in (select l_orderkey from priced)",
        "sync_summary": "select 'full' as type, (select count(*) from headers) as documents_processed, (select count(*) from item_lines) as lines_processed, 0 as documents_deleted, cast(null as double) as seconds",
        "report_trends_periods": _QUARTER_CTE + f"select item_id, idx, period, sold, revenue, {r('avg_monthly', 2)} as avg_monthly from quarters",
        "report_inventory": _STOCK_CTE + f"select item_id, item_name, stock, d as days_of_stock, {r('stock_to_sales', 2)} as stock_to_sales, {r('avg_daily', 2)} as avg_daily, max_daily, recent_trend, stock_status, risk_level, should_reorder, suggested_qty, urgency, case when urgency is not null then 'Only ' || cast(d as varchar) || ' days of stock left' end as rationale, is_overstocked, {r('excess_units')} as excess_units, {r('excess_value', 2)} as excess_value, {r('carrying_cost', 2)} as carrying_cost from stock",
        "report_pricing": _DISCOUNT_CTE + "select item_id, item_name, " + ", ".join(f"{r(f'coalesce({c}, 0)', 2)} as {c}" for c in ("min_price", "max_price", "avg_price", "median_price", "std_dev")) + f", {r('coalesce(variance_pct, 0)', 1)} as variance_pct, coalesce(has_discounts, false) as has_discounts, {r('avg_discount_pct', 1)} as avg_discount_pct, {r('coalesce(discount_frequency, 0)', 3)} as discount_frequency from all_items left join price_stats using (item_id) left join discounts using (item_id)",
        "report_pricing_distribution": _PRICE_CTE + f"select item_id, {r('cast(price as double)', 2)} as price, total_quantity as quantity, {r('total_revenue', 2)} as revenue, {r('coalesce(total_quantity / nullif(sum(total_quantity) over (partition by item_id), 0) * 100, 0)', 1)} as frequency_pct from prices",
        "report_customers": _CUSTOMER_CTE + f", sums as (select item_id, count(*) as n, sum(total_quantity) as q, sum(abs(total_revenue)) as v, sum(case when rk <= 3 then share end) as t3, sum(case when rk <= 5 then share end) as t5, coalesce(sum(pow(share / 100, 2)), 0) as h, count(*) filter (share > 10) as l, count(*) filter (share between 3 and 10) as m, count(*) filter (share < 3) as s from ranked group by item_id) select item_id, item_name, coalesce(n, 0) as total_customers, coalesce(q, 0) as total_quantity, coalesce(v, 0) as total_revenue, {r('case when n is null then 0 else t3 end', 1)} as top_3_share, {r('case when n is null then 0 else t5 end', 1)} as top_5_share, {r('coalesce(h, 0)', 3)} as herfindahl, coalesce(l, 0) as large_customers, coalesce(m, 0) as medium_customers, coalesce(s, 0) as small_customers from all_items left join sums using (item_id)",
        "report_customers_top": _CUSTOMER_CTE + f"select item_id, rank, customer_id, coalesce(a.name, customer_id) as customer_name, total_quantity, abs(total_revenue) as revenue, order_count, {r('share', 1)} as share_pct, {r('total_quantity / order_count', 2)} as avg_order_size from (select *, row_number() over (partition by item_id order by total_revenue desc, customer_id) as rank from shares) x left join accounts a on a.id = x.customer_id where rank <= 10",
        "report_forecast": _HISTORY_CTE + f"select item_id, item_name, {r('coalesce(mean, 0)', 2)} as historical_avg, {r('coalesce(growth, 0)', 3)} as growth_rate, {r('coalesce(volatility, 0)', 3)} as volatility, coalesce(points, 0) as points, {_CONF} as confidence from all_items left join history using (item_id)",
        "report_forecast_months": _HISTORY_CTE + f", ahead(step, month) as (values (1, '2001-09'), (2, '2001-10'), (3, '2001-11')), predicted as (select item_id, month, greatest(0.0, {r('coalesce(mean, 0) * (1 + coalesce(growth, 0) / 6 * step)')}) as predicted_quantity, rpu, volatility, points from all_items left join history using (item_id), ahead) select item_id, month, predicted_quantity, {r('predicted_quantity * coalesce(rpu, 0)', 2)} as predicted_revenue, {_CONF} as confidence from predicted",
        "report_patterns": _MATCH_CTE + f", sizes as ({_SIZES}), spread as ({_SPREAD}), cycle as ({_CYCLE}), wins as ({_WIN}) select item_id, item_name, coalesce(total_orders, 0) as total_orders, coalesce(small, 0) as small, coalesce(medium, 0) as medium, coalesce(large, 0) as large, {r('coalesce(avg_size, 0)', 2)} as avg_size, {r('coalesce(median_size, 0)', 2)} as median_size, coalesce(min_size, 0) as min_size, coalesce(max_size, 0) as max_size, coalesce(frequency_days, 0) as frequency_days, avg_cycle_days, median_cycle_days, created, converted, open, lost, win_rate from all_items left join (select *, {_FREQ} from sizes) using (item_id) left join spread using (item_id) left join cycle using (item_id) left join wins using (item_id)",
    }
    return {k: BASE + v for k, v in found.items()}
