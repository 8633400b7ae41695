"""G registrations (unfiltered dashboard state)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Params
from ..functions.filters import Slice
from ..operators import dashboard as D
from ..operators import insights as G
from .oracle import with_base
from .registry import register

ALL = Slice()


def _blocks(p: Params) -> str:
    """SQL building blocks mirroring dashboard / insights for the unfiltered slice."""
    near_empty = (f"last_revenue < {float(p.near_empty_month_revenue)!r}" if p.near_empty_month_share is None else
                  f"last_revenue * (n - 1) < {p.near_empty_month_share!r} * (sum_revenue - last_revenue)")
    return f"""
kp AS (SELECT COALESCE(CAST(sum(revenue) AS DOUBLE), 0) AS total_revenue, count(*) AS total_orders,
              count(DISTINCT customer_unique_id) AS total_customers FROM orders_g),
mon AS (SELECT month_year AS order_month, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(*) AS total_orders
        FROM orders_g GROUP BY 1),
spine AS (SELECT strftime(d, '%Y-%m') AS order_month
          FROM (SELECT unnest(generate_series(CAST(min(month_year) || '-01' AS DATE),
                                              CAST(max(month_year) || '-01' AS DATE), INTERVAL 1 MONTH)) AS d
                FROM orders_g) g),
tr AS (SELECT s.order_month, COALESCE(m.total_revenue, 0.0) AS total_revenue, COALESCE(m.total_orders, 0) AS total_orders
       FROM spine s LEFT JOIN mon m ON s.order_month = m.order_month),
trx AS (SELECT *, row_number() OVER (ORDER BY order_month) - 1 AS idx,
               lag(total_revenue) OVER (ORDER BY order_month) AS prev_revenue,
               lag(total_orders) OVER (ORDER BY order_month) AS prev_orders FROM tr),
pick AS (SELECT CASE WHEN n < 2 THEN NULL WHEN {near_empty} AND n >= 3 THEN n - 2 ELSE n - 1 END AS target_idx
         FROM (SELECT count(*) AS n, arg_max(total_revenue, order_month) AS last_revenue, sum(total_revenue) AS sum_revenue FROM trx) z),
g2 AS (SELECT t.order_month AS target_month,
              CASE WHEN t.prev_revenue IS NULL OR t.prev_revenue = 0 THEN NULL
                   ELSE (t.total_revenue - t.prev_revenue) / t.prev_revenue * 100.0 END AS revenue_growth,
              CASE WHEN t.prev_orders IS NULL OR t.prev_orders = 0 THEN NULL
                   ELSE (CAST(t.total_orders AS DOUBLE) - CAST(t.prev_orders AS DOUBLE)) / CAST(t.prev_orders AS DOUBLE)
                        * 100.0 END AS order_growth
       FROM pick LEFT JOIN trx t ON t.idx = pick.target_idx AND pick.target_idx > 0),
cats AS (SELECT product_category_name_english AS product_category,
                CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders
         FROM fact GROUP BY 1),
sts AS (SELECT state_code, CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(*) AS total_orders,
               count(DISTINCT customer_unique_id) AS total_customers FROM orders_g GROUP BY 1),
cust AS (SELECT customer_unique_id, sum(revenue) AS lifetime_revenue, count(*) AS order_count FROM orders_g GROUP BY 1),
snap AS (SELECT CAST(COALESCE(sum(CASE WHEN order_count > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeat_customers,
                count(*) AS snapshot_customers,
                CAST(sum(lifetime_revenue) AS DOUBLE) / count(lifetime_revenue) AS avg_lifetime_spend FROM cust),
topcat AS (SELECT product_category AS top_category, total_revenue AS top_category_revenue FROM cats
           ORDER BY total_revenue DESC, product_category LIMIT 1),
topstate AS (SELECT state_code AS top_state, total_revenue AS top_state_revenue FROM sts
             ORDER BY total_revenue DESC, state_code LIMIT 1),
rowk AS (SELECT kp.*, g2.*, topcat.*, topstate.*, snap.*,
                CASE WHEN kp.total_revenue > 0 THEN top_category_revenue / kp.total_revenue * 100.0 END AS top_category_share,
                CASE WHEN kp.total_revenue > 0 THEN top_state_revenue / kp.total_revenue * 100.0 END AS top_state_share,
                CASE WHEN snapshot_customers > 0
                     THEN CAST(repeat_customers AS DOUBLE) / CAST(snapshot_customers AS DOUBLE) * 100.0 ELSE 0.0 END
                  AS repeat_pct
         FROM kp, g2 LEFT JOIN topcat ON TRUE LEFT JOIN topstate ON TRUE, snap)"""


def gsql(body: str):
    return lambda p: with_base(body, p, _blocks(p))


@register("g1_g3_mom_growth", gsql("""
SELECT order_month, total_revenue, total_orders,
       CASE WHEN prev_revenue IS NULL OR prev_revenue = 0 THEN NULL
            ELSE (total_revenue - prev_revenue) / prev_revenue * 100.0 END AS revenue_growth_pct,
       CASE WHEN prev_orders IS NULL OR prev_orders = 0 THEN NULL
            ELSE (CAST(total_orders AS DOUBLE) - CAST(prev_orders AS DOUBLE)) / CAST(prev_orders AS DOUBLE) * 100.0
       END AS order_growth_pct,
       CASE WHEN prev_revenue IS NULL OR prev_revenue = 0 THEN 'neutral'
            WHEN total_revenue > prev_revenue THEN 'up' WHEN total_revenue < prev_revenue THEN 'down'
            ELSE 'neutral' END AS revenue_trend
FROM trx"""))
def g1(ctx):
    from pyspark.sql import Window
    t = D.monthly_trend(ctx, ALL).select("order_month", "total_revenue", "total_orders", "revenue_growth_pct")
    w = Window.orderBy("order_month")
    return (t.withColumn("order_growth_pct", G.growth_pct(F.col("total_orders").cast("double"),
                                                           F.lag(F.col("total_orders").cast("double")).over(w)))
             .withColumn("revenue_trend", G.trend_label(F.col("revenue_growth_pct"))))


@register("g2_latest_full_month", gsql("SELECT * FROM g2"))
def g2(ctx):
    return G.latest_full_month(D.monthly_trend(ctx, ALL), None, ctx.params)


@register("g4_revenue_share", gsql("""
SELECT c.product_category, c.total_revenue,
       CASE WHEN kp.total_revenue > 0 THEN c.total_revenue / kp.total_revenue * 100.0 ELSE 0.0 END AS revenue_share_pct
FROM (SELECT * FROM cats ORDER BY total_revenue DESC, product_category LIMIT 5) c, kp"""))
def g4(ctx):
    top = D.category_performance(ctx, ALL, 5).select("product_category", "total_revenue")
    return G.with_share(top, D.overall_kpis(ctx, ALL).select("total_revenue"))


@register("g5_bottom_states", gsql("""
SELECT state_code, total_revenue FROM (
  SELECT state_code, total_revenue, row_number() OVER (ORDER BY total_revenue, state_code) AS r,
         count(*) OVER () AS n FROM sts) t WHERE r <= 5 AND n > 10"""))
def g5(ctx):
    return G.bottom_n(D.all_states(ctx, ALL).select("state_code", "total_revenue"), "state_code")


@register("g6_repeat_rate", gsql("""
SELECT repeat_customers, snapshot_customers AS total_customers, repeat_pct FROM rowk"""))
def g6(ctx):
    snap = D.customer_snapshot(ctx, ALL)
    return snap.select("repeat_customers", "total_customers", G.repeat_rate().alias("repeat_pct"))


@register("g13_month_extremes", gsql("""
SELECT arg_max(order_month, (total_revenue, order_month)) AS best_month, max(total_revenue) AS best_revenue,
       arg_min(order_month, (total_revenue, order_month)) AS worst_month, min(total_revenue) AS worst_revenue,
       count(*) FILTER (WHERE total_revenue > 0) AS active_months,
       (SELECT total_revenue FROM kp) / greatest(count(*) FILTER (WHERE total_revenue > 0), 1) AS monthly_average
FROM tr"""))
def g13(ctx):
    return G.month_extremes(D.monthly_trend(ctx, ALL), D.overall_kpis(ctx, ALL))


@register("g15_sentiment_flags", gsql("""
SELECT CASE WHEN revenue_growth IS NULL THEN 'neutral' WHEN revenue_growth >= 5 THEN 'positive'
            WHEN revenue_growth <= -5 THEN 'warning' ELSE 'neutral' END AS revenue_sentiment,
       CASE WHEN top_category_share IS NULL THEN 'neutral' WHEN top_category_share > 40 THEN 'warning'
            WHEN top_category_share < 20 THEN 'positive' ELSE 'neutral' END AS category_sentiment,
       CASE WHEN top_state_share IS NULL THEN 'neutral' WHEN top_state_share > 40 THEN 'warning'
            WHEN top_state_share < 20 THEN 'positive' ELSE 'neutral' END AS geography_sentiment,
       CASE WHEN repeat_pct < 5 THEN 'warning' WHEN repeat_pct > 20 THEN 'positive' ELSE 'neutral' END
         AS customer_sentiment
FROM rowk"""))
def g15(ctx):
    return G.sentiment_flags(G.kpi_row(ctx, ALL, ctx.params))


INSIGHT_COLS = "domain, type, severity, metric, subject, value"

RISKS_SQL = """
SELECT 'summary' AS domain, 'risk' AS type, 'warning' AS severity, 'repeat_pct' AS metric,
       CAST(NULL AS VARCHAR) AS subject, repeat_pct AS value FROM rowk WHERE repeat_pct < 10 AND total_customers > 0
UNION ALL SELECT 'summary', 'risk', 'warning', 'top_category_share', top_category, top_category_share
  FROM rowk WHERE top_category_share > 40
UNION ALL SELECT 'summary', 'risk', 'warning', 'top_state_share', top_state, top_state_share
  FROM rowk WHERE top_state_share > 40"""


@register("g16_risk_flags", gsql(RISKS_SQL))
def g16(ctx):
    return G.risk_flags(G.kpi_row(ctx, ALL, ctx.params))


EXEC_SQL = """
SELECT 'executive' AS domain, 'growth' AS type,
       CASE WHEN revenue_growth > 10 THEN 'positive' WHEN revenue_growth < -5 THEN 'critical' ELSE 'neutral' END
         AS severity, 'revenue_growth' AS metric, top_category AS subject, revenue_growth AS value
FROM rowk WHERE revenue_growth IS NOT NULL
UNION ALL SELECT 'executive', CASE WHEN top_state_share > 40 THEN 'warning' ELSE 'trend' END,
       CASE WHEN top_state_share > 40 THEN 'warning' ELSE 'positive' END, 'top_state_share', top_state, top_state_share
FROM rowk WHERE top_state IS NOT NULL AND top_state_share IS NOT NULL
UNION ALL SELECT 'executive', 'segment', CASE WHEN repeat_pct < 5 THEN 'warning' ELSE 'positive' END, 'repeat_pct',
       NULL, repeat_pct FROM rowk WHERE repeat_pct IS NOT NULL AND (repeat_pct < 5 OR repeat_pct > 20)
UNION ALL SELECT 'executive', 'growth', 'positive', 'order_growth', NULL, order_growth
FROM rowk WHERE order_growth IS NOT NULL AND order_growth > 15"""


@register("g17_executive_insights", gsql(EXEC_SQL))
def g17(ctx):
    return G.executive_insights(G.kpi_row(ctx, ALL, ctx.params))


def _sales_sql(trend_cte: str = "tr") -> str:
    return f"""
SELECT 'sales' AS domain, 'trend' AS type, 'positive' AS severity, 'top_category' AS metric,
       product_category AS subject, total_revenue AS value
FROM (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_category) AS r FROM cats) c WHERE r = 1
UNION ALL
SELECT 'sales', 'warning', 'warning', 'bottom_category', product_category, total_revenue
FROM (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_category) AS r, count(*) OVER () AS n
      FROM cats) c WHERE r = n AND n > 1 AND total_revenue > 0
UNION ALL
SELECT 'sales', 'trend', CASE WHEN (cur - prev) / prev * 100.0 > 0 THEN 'positive' ELSE 'warning' END,
       'monthly_revenue_change', NULL, (cur - prev) / prev * 100.0
FROM (SELECT max(CASE WHEN r = 1 THEN total_revenue END) AS cur, max(CASE WHEN r = 2 THEN total_revenue END) AS prev
      FROM (SELECT *, row_number() OVER (ORDER BY order_month DESC) AS r, count(*) OVER () AS n FROM {trend_cte}) t
      WHERE r <= 2 AND n >= 3) z WHERE prev > 0"""


@register("g18_sales_insights", gsql(_sales_sql()))
def g18(ctx):
    return G.sales_insights(D.category_performance(ctx, ALL),
                            D.monthly_trend(ctx, ALL, honour_month=True, with_customers=False))


CUST_SQL = """
SELECT 'customers' AS domain, 'segment' AS type,
       CASE WHEN repeat_pct > 10 THEN 'positive' ELSE 'warning' END AS severity, 'repeat_pct' AS metric,
       CAST(NULL AS VARCHAR) AS subject, repeat_pct AS value FROM rowk
UNION ALL SELECT 'customers', 'trend', 'neutral', 'avg_lifetime_spend', NULL, avg_lifetime_spend FROM rowk
WHERE avg_lifetime_spend > 0"""


@register("g19_customer_insights", gsql(CUST_SQL))
def g19(ctx):
    return G.customer_insights(D.customer_overview(ctx, ALL))


GEO_SQL = """
SELECT 'geography' AS domain, 'trend' AS type, 'positive' AS severity, 'leader_share' AS metric,
       state_code AS subject, total_revenue / (SELECT total_revenue FROM kp) * 100.0 AS value
FROM (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, state_code) AS r FROM sts) s
WHERE r = 1 AND (SELECT total_revenue FROM kp) > 0
UNION ALL
SELECT 'geography', 'warning', 'warning', 'bottom5_share', NULL, b / (SELECT total_revenue FROM kp) * 100.0
FROM (SELECT sum(total_revenue) AS b FROM (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, state_code) AS r,
                                                  count(*) OVER () AS n FROM sts) s WHERE n >= 5 AND r > n - 5) z
WHERE (SELECT total_revenue FROM kp) > 0 AND b IS NOT NULL"""


@register("g20_geography_insights", gsql(GEO_SQL))
def g20(ctx):
    return G.geography_insights(D.all_states(ctx, ALL), D.state_totals(ctx, ALL))


PROD_SQL = """
SELECT 'products' AS domain, 'trend' AS type, 'positive' AS severity, 'top_category_share' AS metric,
       product_category AS subject, CASE WHEN tot > 0 THEN total_revenue / tot * 100.0 END AS value
FROM (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_category) AS r, count(*) OVER () AS n,
             sum(total_revenue) OVER () AS tot FROM cats) c WHERE r = 1
UNION ALL
SELECT 'products', 'warning', 'warning', 'bottom_category_share', product_category,
       CASE WHEN tot > 0 THEN total_revenue / tot * 100.0 END
FROM (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product_category) AS r, count(*) OVER () AS n,
             sum(total_revenue) OVER () AS tot FROM cats) c WHERE r = n AND n > 1"""


@register("g21_product_insights", gsql(PROD_SQL))
def g21(ctx):
    return G.product_insights(D.category_performance(ctx, ALL))


@register("g22_consolidated_insights", gsql(
    f"{EXEC_SQL}\nUNION ALL\n{_sales_sql()}\nUNION ALL\n{CUST_SQL}\nUNION ALL\n{GEO_SQL}\nUNION ALL\n{PROD_SQL}"))
def g22(ctx):
    return G.consolidated_insights(ctx, ALL, ctx.params)
