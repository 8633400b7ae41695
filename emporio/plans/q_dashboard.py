"""F1-F25 registrations: each dashboard query unfiltered and under slices
that exercise both physical paths of F2 (order table / item fact)."""

from __future__ import annotations

from ..config import Params
from ..functions.filters import Slice
from ..operators import dashboard as D
from ..operators import reporting as R
from .oracle import with_base
from .registry import orders_sql, register

ALL = Slice()
ORDER_SLICE = Slice.of(state="sc", segment="repeat")          # order-table path
ITEM_SLICE = Slice.of(category="economy", month="2000-06")    # item-fact path
SELLER_SLICE = Slice.of(seller="7", segment="all")            # seller filter; 'all' = no filter

SLICES = {"all": ALL, "state_segment": ORDER_SLICE, "category_month": ITEM_SLICE,
          "seller": SELLER_SLICE}


def _variants(prefix: str, build, oracle, slices=("all", "state_segment", "category_month")):
    for tag in slices:
        s = SLICES[tag]
        register(f"{prefix}_{tag}" if tag != "all" else prefix,
                 (lambda p_s: (lambda p: with_base(oracle(p_s, p), p)))(s))(
            (lambda b_s: (lambda ctx: build(ctx, b_s)))(s))


# --- F3 / F9 -----------------------------------------------------------------------------
def _kpi_sql(s: Slice, p: Params) -> str:
    return f"""
SELECT COALESCE(CAST(sum(revenue) AS DOUBLE), 0) AS total_revenue, count(*) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers,
       CASE WHEN count(*) > 0 THEN COALESCE(CAST(sum(revenue) AS DOUBLE), 0) / count(*) ELSE 0 END
         AS average_order_value
FROM {orders_sql(s)} o"""


_variants("f3_overall_kpis", D.overall_kpis, _kpi_sql, ("all", "state_segment", "category_month", "seller"))


def _sales_kpi_sql(s, p):
    return f"SELECT total_revenue, total_orders, average_order_value FROM ({_kpi_sql(s, p)}) k"


_variants("f9_sales_kpis", D.sales_kpis, _sales_kpi_sql, ("all", "category_month"))


# --- F4 / F5 -----------------------------------------------------------------------------
def _trend_sql(s: Slice, p: Params, honour_month: bool, with_customers: bool) -> str:
    if not honour_month:
        s = s.without("month")
    cust = ", count(DISTINCT customer_unique_id) AS total_customers" if with_customers else ""
    cust_out = ", COALESCE(m.total_customers, 0) AS total_customers" if with_customers else ""
    return f"""
SELECT order_month, year_number, month_number, total_revenue, total_orders{', total_customers' if with_customers else ''},
       average_order_value,
       CASE WHEN lag(total_revenue) OVER (ORDER BY order_month) IS NULL
              OR lag(total_revenue) OVER (ORDER BY order_month) = 0 THEN NULL
            ELSE (total_revenue - lag(total_revenue) OVER (ORDER BY order_month))
                 / lag(total_revenue) OVER (ORDER BY order_month) * 100.0 END AS revenue_growth_pct
FROM (
  SELECT sp.order_month, CAST(substr(sp.order_month, 1, 4) AS INTEGER) AS year_number,
         CAST(substr(sp.order_month, 6, 2) AS INTEGER) AS month_number,
         COALESCE(m.total_revenue, 0.0) AS total_revenue, COALESCE(m.total_orders, 0) AS total_orders{cust_out},
         CASE WHEN COALESCE(m.total_orders, 0) > 0
              THEN COALESCE(m.total_revenue, 0.0) / COALESCE(m.total_orders, 0) ELSE 0 END AS average_order_value
  FROM (SELECT strftime(d, '%Y-%m') AS order_month
        FROM (SELECT unnest(generate_series(CAST(min(month_year) || '-01' AS DATE),
                                            CAST(max(month_year) || '-01' AS DATE), INTERVAL 1 MONTH)) AS d
              FROM {orders_sql(s)} b HAVING min(month_year) IS NOT NULL) g) sp
  LEFT JOIN (SELECT month_year AS order_month, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
                    count(*) AS total_orders{cust}
             FROM {orders_sql(s)} o GROUP BY month_year) m ON sp.order_month = m.order_month) t"""


_variants("f4_monthly_trend", D.monthly_trend,
          lambda s, p: _trend_sql(s, p, False, True))
_variants("f5_sales_monthly_trend",
          lambda ctx, s: D.monthly_trend(ctx, s, honour_month=True, with_customers=False),
          lambda s, p: _trend_sql(s, p, True, False), ("all", "state_segment"))


# --- F6 / F10 / F16 -------------------------------------------------------------------------
def _category_sql(s: Slice, p: Params, limit: int | None) -> str:
    lim = f"ORDER BY total_revenue DESC, product_category ASC LIMIT {limit}" if limit else ""
    return f"""
SELECT product_category_name_english AS product_category,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers, CAST(sum(quantity) AS BIGINT) AS total_items_sold,
       CASE WHEN sum(quantity) > 0 THEN CAST(sum(total_sales_amount) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE)
            ELSE 0 END AS average_item_price
FROM fact WHERE {s.sql()} GROUP BY 1 {lim}"""


_variants("f6_top_categories", lambda ctx, s: D.category_performance(ctx, s, 5),
          lambda s, p: _category_sql(s, p, 5))
_variants("f10_category_performance", lambda ctx, s: D.category_performance(ctx, s, 8),
          lambda s, p: _category_sql(s, p, 8), ("all", "state_segment"))
_variants("f16_all_categories", lambda ctx, s: D.category_performance(ctx, s, None),
          lambda s, p: _category_sql(s, p, None), ("all", "category_month"))


# --- F7 / F11 / F18 / F19 ---------------------------------------------------------------------
def _state_sql(s: Slice, p: Params, limit: int | None, cols: str = "*") -> str:
    lim = f"ORDER BY total_revenue DESC, state_code ASC LIMIT {limit}" if limit else ""
    return f"""
SELECT {cols} FROM (
SELECT state_code, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(*) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers, CAST(sum(freight) AS DOUBLE) AS total_freight_cost
FROM {orders_sql(s)} o GROUP BY 1 {lim}) t"""


_variants("f7_top_states", lambda ctx, s: D.state_performance(ctx, s, 5),
          lambda s, p: _state_sql(s, p, 5))
_variants("f11_sales_by_state", lambda ctx, s: D.sales_by_state(ctx, s),
          lambda s, p: _state_sql(s, p, 6, "state_code, total_revenue, total_orders"), ("all", "category_month"))
_variants("f18_all_states", D.all_states,
          lambda s, p: _state_sql(s.without("state"), p, None), ("all", "state_segment"))


def _state_totals_sql(s, p):
    return f"""
SELECT COALESCE(CAST(sum(revenue) AS DOUBLE), 0) AS total_revenue, count(*) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers,
       COALESCE(CAST(sum(freight) AS DOUBLE), 0) AS total_freight_cost,
       count(DISTINCT state_code) AS total_states
FROM {orders_sql(s)} o"""


_variants("f19_state_totals", D.state_totals, _state_totals_sql, ("all", "category_month"))


# --- F8 / F12 / F13 / F14 -----------------------------------------------------------------------
def _cust_sql(s: Slice) -> str:
    return f"""(SELECT customer_unique_id, sum(revenue) AS lifetime_revenue, count(*) AS order_count,
               CAST(sum(quantity) AS BIGINT) AS total_items
        FROM {orders_sql(s)} o GROUP BY 1)"""


_variants("f8_customer_snapshot", D.customer_snapshot, lambda s, p: f"""
SELECT CAST(COALESCE(sum(CASE WHEN order_count > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeat_customers,
       CAST(COALESCE(sum(CASE WHEN order_count = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS one_time_customers,
       count(*) AS total_customers
FROM {_cust_sql(s)} c""")

_variants("f12_customer_overview", D.customer_overview, lambda s, p: f"""
SELECT count(*) AS total_customers, count(*) FILTER (WHERE order_count > 1) AS repeat_customers,
       count(*) FILTER (WHERE order_count = 1) AS one_time_customers,
       CAST(sum(lifetime_revenue) AS DOUBLE) / count(lifetime_revenue) AS avg_lifetime_spend,
       CAST(sum(order_count) AS DOUBLE) / count(order_count) AS avg_orders
FROM {_cust_sql(s)} c""")


def _tier_sql(s: Slice, p: Params) -> str:
    labels = p.tier_labels()
    whens = " ".join(f"WHEN lifetime_revenue < {e!r} THEN '{labels[i]}'" for i, e in enumerate(p.tier_edges))
    return f"""
SELECT CASE {whens} ELSE '{labels[-1]}' END AS tier, count(*) AS customer_count,
       CAST(sum(lifetime_revenue) AS DOUBLE) AS tier_revenue,
       CAST(sum(lifetime_revenue) AS DOUBLE) / count(lifetime_revenue) AS avg_spend,
       CAST(min(lifetime_revenue) AS DOUBLE) AS min_spend
FROM {_cust_sql(s)} c GROUP BY 1"""


_variants("f13_spending_tiers", lambda ctx, s: D.spending_tiers(ctx, s, ctx.params), _tier_sql)


_variants("f14_top_customers", lambda ctx, s: D.top_customers(ctx, s, ctx.params), lambda s, p: f"""
SELECT customer_unique_id, CAST(lifetime_revenue AS DOUBLE) AS lifetime_revenue, order_count AS total_orders,
       total_items, CASE WHEN order_count > 0 THEN CAST(lifetime_revenue AS DOUBLE) / order_count ELSE 0 END
         AS average_order_value,
       CAST(CASE WHEN order_count > 1 THEN 1 ELSE 0 END AS INTEGER) AS is_repeat_customer
FROM {_cust_sql(s)} c ORDER BY lifetime_revenue DESC, customer_unique_id ASC LIMIT {p.top_n_customers}""")


# --- F17 ------------------------------------------------------------------------------------------
_variants("f17_top_sellers", lambda ctx, s: D.seller_ranking(ctx, s, 20), lambda s, p: f"""
SELECT seller_id, max(seller_city) AS seller_city, max(seller_state) AS seller_state,
       count(DISTINCT order_id) AS total_orders, CAST(sum(quantity) AS BIGINT) AS total_items,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue
FROM fact WHERE {s.sql()} AND seller_id <> 'unknown' GROUP BY 1
ORDER BY total_revenue DESC, seller_id ASC LIMIT 20""", ("all", "state_segment"))


# --- F21 / F23 / F24 / F25 ------------------------------------------------------------------------
@register("f21_customer_categories", lambda p: with_base("""
SELECT DISTINCT product_category_name_english AS product_category FROM fact
WHERE customer_unique_id = '7' AND product_category_name_english IS NOT NULL""", p))
def f21(ctx):
    return D.customer_categories(ctx, "7")


@register("f23_filter_options", lambda p: with_base("""
SELECT DISTINCT 'category' AS kind, product_category_name_english AS value FROM fact
  WHERE product_category_name_english <> 'unknown'
UNION ALL SELECT DISTINCT 'state', state_code FROM fact WHERE state_code <> 'unknown'
UNION ALL SELECT DISTINCT 'month', month_year FROM fact
UNION ALL SELECT 'seller', seller_id FROM (
  SELECT seller_id, sum(total_sales_amount) AS rev FROM fact WHERE seller_id <> 'unknown'
  GROUP BY 1 ORDER BY rev DESC, seller_id LIMIT 100) s""", p))
def f23(ctx):
    return D.filter_options(ctx)


def _search_sql(q: str):
    ok = "TRUE" if len(q) >= 2 else "FALSE"
    return lambda p: with_base(f"""
SELECT * FROM (SELECT DISTINCT 'category' AS kind, product_category_name_english AS value FROM fact
               WHERE product_category_name_english <> 'unknown'
                 AND contains(lower(product_category_name_english), '{q}') AND {ok}
               ORDER BY value LIMIT 5) c
UNION ALL
SELECT * FROM (SELECT DISTINCT 'state' AS kind, state_code AS value FROM fact
               WHERE state_code <> 'unknown' AND contains(lower(state_code), '{q}') AND {ok}
               ORDER BY value LIMIT 3) s""", p)


for _q in ("ar", "sc", "s"):
    register(f"f24_search_{_q}", _search_sql(_q))((lambda q: (lambda ctx: D.search(ctx, q)))(_q))


_variants("f25_cube_slice", D.cube_slice, lambda s, p: f"""
SELECT CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers, CAST(sum(quantity) AS BIGINT) AS total_items_sold
FROM fact WHERE {s.sql()}""", ("all", "state_segment", "category_month"))


# --- F1 / F2 --------------------------------------------------------------------------------------
@register("f1_slice_filter", lambda p: with_base(f"SELECT * FROM fact WHERE {ORDER_SLICE.sql()}", p))
def f1(ctx):
    return ORDER_SLICE.apply(ctx.fact)


_ROUTED = {"all": ALL, "state_segment": ORDER_SLICE, "category_month": ITEM_SLICE, "seller": SELLER_SLICE}


def _f2_sql(p):
    parts = []
    for tag, s in _ROUTED.items():
        src = "order_table" if set(s.active()) <= {"month", "state", "segment"} else "item_fact"
        parts.append(f"""SELECT '{tag}' AS slice, '{src}' AS source, count(*) AS orders,
                          CAST(sum(revenue) AS DOUBLE) AS revenue FROM {orders_sql(s)} o""")
    return with_base(" UNION ALL ".join(parts), p)


@register("f2_summary_routing", _f2_sql)
def f2(ctx):
    from functools import reduce
    from pyspark.sql import functions as F
    parts = []
    for tag, s in _ROUTED.items():
        src = "order_table" if D.uses_order_table(s) else "item_fact"
        o = D.order_source(ctx, s)
        parts.append(o.agg(F.count(F.lit(1)).cast("long").alias("orders"),
                           F.sum("revenue").cast("double").alias("revenue"))
                      .select(F.lit(tag).alias("slice"), F.lit(src).alias("source"), "orders", "revenue"))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- F2: the same questions answered by each table that can ------------------------------------------
KNOWN_CATEGORY = Slice.of(category="economy", segment="repeat")


def _routed(name: str, build, oracle, s: Slice, tables: tuple[str, ...]):
    for table in tables:
        register(f"f2_{name}_from_{table}", lambda p, s=s: with_base(oracle(s, p), p))(
            lambda ctx, table=table: build(ctx, s, table))


_routed("sales_kpis", lambda ctx, s, t: D.sales_kpis(ctx, s, using=t), _sales_kpi_sql, KNOWN_CATEGORY,
        ("categories", "order_categories", "fact"))
_routed("seller_kpis", lambda ctx, s, t: D.sales_kpis(ctx, s, using=t), _sales_kpi_sql, SELLER_SLICE, ("sellers", "fact"))
_routed("sales_trend", lambda ctx, s, t: D.monthly_trend(ctx, s, True, False, using=t),
        lambda s, p: _trend_sql(s, p, True, False), ORDER_SLICE, ("monthly", "orders", "fact"))
_routed("overall_kpis", lambda ctx, s, t: D.overall_kpis(ctx, s, using=t), _kpi_sql, Slice.of(segment="repeat"),
        ("customers", "orders", "fact"))
_routed("category_performance", lambda ctx, s, t: D.category_performance(ctx, s, using=t),
        lambda s, p: _category_sql(s, p, None), ORDER_SLICE, ("order_categories", "fact"))
