"""E1-E20 registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting as R
from .registry import register, sql


@register("e1_sales_summary", sql("""
SELECT year_number, month_number, month_year AS order_month,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers,
       CASE WHEN count(DISTINCT order_id) > 0
            THEN CAST(sum(total_sales_amount) AS DOUBLE) / count(DISTINCT order_id) ELSE 0 END
         AS average_order_value
FROM fact GROUP BY year_number, month_number, month_year"""))
def e1(ctx):
    return R.sales_summary(ctx.fact, ctx.single_orders)


@register("e2_category_summary", sql("""
SELECT COALESCE(product_category_name_english, 'Uncategorized') AS product_category,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders, count(*) AS total_items_sold,
       CAST(sum(price) AS DOUBLE) / count(price) AS average_item_price
FROM enriched GROUP BY 1"""))
def e2(ctx):
    return R.category_summary(ctx.enriched)


@register("e3_category_summary_denorm", sql("""
SELECT product_category_name_english AS product_category,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders,
       CAST(sum(quantity) AS BIGINT) AS total_items_sold,
       CASE WHEN sum(quantity) > 0 THEN CAST(sum(total_sales_amount) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE)
            ELSE 0 END AS average_item_price
FROM fact WHERE product_category_name_english IS NOT NULL GROUP BY 1"""))
def e3(ctx):
    return R.category_summary_denorm(ctx.fact)


@register("e4_state_summary", sql("""
SELECT state_code, CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_unique_id) AS total_customers,
       CAST(sum(freight_value) AS DOUBLE) AS total_freight_cost
FROM enriched WHERE state_code IS NOT NULL GROUP BY state_code"""))
def e4(ctx):
    return R.state_summary(ctx.enriched, ctx.single_orders)


@register("e5_state_summary_denorm", sql("""
SELECT left(state_code, 2) AS state_code, CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_unique_id) AS total_customers,
       CAST(sum(freight_value) AS DOUBLE) AS total_freight_cost
FROM fact WHERE state_code IS NOT NULL AND length(state_code) = 2 GROUP BY left(state_code, 2)"""))
def e5(ctx):
    return R.state_summary_denorm(ctx.fact, ctx.single_orders)


@register("e6_customer_summary", sql("""
SELECT customer_unique_id, CAST(sum(total_sales_amount) AS DOUBLE) AS lifetime_revenue,
       count(DISTINCT order_id) AS total_orders, count(*) AS total_items_purchased,
       CAST(sum(total_sales_amount) AS DOUBLE) / count(DISTINCT order_id) AS average_order_value,
       CAST(CASE WHEN count(DISTINCT order_id) > 1 THEN 1 ELSE 0 END AS INTEGER) AS is_repeat_customer
FROM enriched WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id"""))
def e6(ctx):
    return R.customer_summary(ctx.enriched)


SELLER_SQL = """
SELECT seller_id, seller_state, seller_city, count(DISTINCT order_id) AS orders_fulfilled,
       count(*) AS items_sold, CAST(sum(price) AS DOUBLE) AS gross_item_revenue,
       CAST(sum(freight_value) AS DOUBLE) AS freight_generated,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue_generated
FROM enriched WHERE seller_id IS NOT NULL GROUP BY seller_id, seller_state, seller_city"""


@register("e7_seller_summary", sql(SELLER_SQL))
def e7(ctx):
    return R.seller_performance(ctx.enriched)


@register("e8_sales_by_category", sql("""
SELECT COALESCE(product_category_name_english, 'Uncategorized') AS product_category,
       count(*) AS total_items_sold, count(DISTINCT order_id) AS total_orders,
       CAST(sum(price) AS DOUBLE) AS total_item_revenue,
       CAST(sum(freight_value) AS DOUBLE) AS total_freight_revenue,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_gross_revenue,
       CAST(sum(price) AS DOUBLE) / count(price) AS avg_item_price
FROM enriched GROUP BY 1"""))
def e8(ctx):
    return R.sales_by_category(ctx.enriched)


@register("e9_customer_rfm_summary", sql("""
SELECT customer_unique_id, state_code AS customer_state, customer_city,
       count(DISTINCT order_id) AS total_orders_placed, count(*) AS total_items_purchased,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_lifetime_spend,
       CAST(sum(total_sales_amount) AS DOUBLE) / count(total_sales_amount) AS avg_order_item_spend,
       max(order_date) AS most_recent_purchase_date
FROM enriched WHERE customer_unique_id IS NOT NULL GROUP BY 1, 2, 3"""))
def e9(ctx):
    return R.customer_rfm_summary(ctx.enriched)


@register("e10_monthly_revenue_trend", sql("""
SELECT year_number, month_number, month_year, count(DISTINCT order_id) AS monthly_orders,
       count(*) AS monthly_items_sold, CAST(sum(price) AS DOUBLE) AS monthly_item_revenue,
       CAST(sum(freight_value) AS DOUBLE) AS monthly_freight_revenue,
       CAST(sum(total_sales_amount) AS DOUBLE) AS monthly_gross_revenue,
       CAST(sum(total_sales_amount) AS DOUBLE) / count(total_sales_amount) AS monthly_avg_item_value
FROM enriched GROUP BY 1, 2, 3"""))
def e10(ctx):
    return R.monthly_revenue_trend(ctx.enriched)


@register("e11_seller_performance", sql(SELLER_SQL))
def e11(ctx):
    return R.seller_performance(ctx.enriched)


FILTER_MEASURES = """CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
       CAST(sum(quantity) AS BIGINT) AS total_items_sold, CAST(sum(freight_value) AS DOUBLE) AS total_freight"""


@register("e13_filter_monthly", sql(f"""
SELECT segment, state_code, month_year, year_number, month_number, {FILTER_MEASURES}
FROM fact GROUP BY 1, 2, 3, 4, 5"""))
def e13(ctx):
    return R.filter_monthly(ctx.fact, ctx.single_orders)


@register("e14_filter_totals", sql(f"""
SELECT segment, state_code, {FILTER_MEASURES} FROM fact GROUP BY 1, 2"""))
def e14(ctx):
    return R.filter_totals(ctx.fact, ctx.single_orders)


@register("e15_filter_categories", sql("""
SELECT segment, product_category_name_english AS product_category,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders,
       CAST(sum(quantity) AS BIGINT) AS total_items_sold
FROM fact GROUP BY 1, 2"""))
def e15(ctx):
    return R.filter_categories(ctx.fact)


@register("e13_e15_filter_grouping_sets", sql(f"""
SELECT segment, state_code, month_year, product_category_name_english AS product_category,
       CAST(grouping(segment, state_code, month_year, product_category_name_english) AS INTEGER) AS gid,
       {FILTER_MEASURES}
FROM fact
GROUP BY GROUPING SETS ((segment, state_code, month_year), (segment, state_code),
                        (segment, product_category_name_english))"""))
def e13_15(ctx):
    return R.filter_grouping_sets(ctx.fact).withColumn("gid", F.col("gid").cast("int"))


@register("e16_filter_customer_orders", sql("""
SELECT customer_unique_id, CAST(sum(total_sales_amount) AS DOUBLE) AS lifetime_revenue,
       count(DISTINCT order_id) AS order_count, CAST(sum(quantity) AS BIGINT) AS total_items,
       max(segment) AS segment, max(state_code) AS state_code
FROM fact GROUP BY 1"""))
def e16(ctx):
    return R.filter_customer_orders(ctx.fact)


@register("e17_exec_orders", sql("""
SELECT order_id, max(customer_unique_id) AS customer_unique_id, max(segment) AS segment,
       max(state_code) AS state_code, max(month_year) AS month_year,
       CAST(sum(total_sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(sum(freight_value) AS DOUBLE) AS freight
FROM fact GROUP BY 1"""))
def e17(ctx):
    return R.exec_orders(ctx.fact)


@register("e18_cube_ssc", sql("""
SELECT segment, state_code, product_category_name_english AS category,
       CAST(sum(total_sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity,
       count(DISTINCT order_id) AS orders, count(DISTINCT customer_unique_id) AS customers
FROM fact WHERE product_category_name_english <> 'unknown' GROUP BY 1, 2, 3"""))
def e18(ctx):
    return R.cube_ssc(ctx.fact)


@register("e19_cube_seller", sql("""
SELECT segment, state_code, month_year, seller_id, max(seller_city) AS seller_city,
       max(seller_state) AS seller_state, CAST(sum(total_sales_amount) AS DOUBLE) AS revenue,
       CAST(sum(quantity) AS BIGINT) AS quantity, count(DISTINCT order_id) AS orders
FROM fact WHERE seller_id <> 'unknown' GROUP BY 1, 2, 3, 4"""))
def e19(ctx):
    return R.cube_seller(ctx.fact)


@register("e20_stale_check", sql("""
SELECT f.fact_customers, f.fact_orders, c.customer_rows, o.order_rows,
       (c.customer_rows = 0 OR c.customer_rows <> f.fact_customers) AS customers_stale,
       (o.order_rows = 0 OR o.order_rows <> f.fact_orders) AS orders_stale
FROM (SELECT count(DISTINCT customer_unique_id) AS fact_customers, count(DISTINCT order_id) AS fact_orders
      FROM fact) f,
     (SELECT count(*) AS customer_rows FROM (SELECT customer_unique_id FROM fact GROUP BY 1) t) c,
     (SELECT count(*) AS order_rows FROM orders_g) o"""))
def e20(ctx):
    return R.staleness(ctx.fact, R.filter_customer_orders(ctx.fact), ctx.orders)


# --- A7: a page of a report table -------------------------------------------------------
@register("a7_paged_report", sql("""
SELECT * FROM (
SELECT year_number, month_number, month_year AS order_month,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers,
       CASE WHEN count(DISTINCT order_id) > 0
            THEN CAST(sum(total_sales_amount) AS DOUBLE) / count(DISTINCT order_id) ELSE 0 END
         AS average_order_value
FROM fact GROUP BY year_number, month_number, month_year) t
ORDER BY order_month LIMIT 20 OFFSET 20"""))
def a7(ctx):
    from ..sources.sinks import paged_report
    rows, _ = paged_report(R.sales_summary(ctx.fact), "reporting_sales_summary", page=2, page_size=20)
    return rows


@register("a7_paged_report_total", sql("""
SELECT count(*) AS total_rows FROM (SELECT DISTINCT month_year FROM fact) t"""))
def a7t(ctx):
    from ..sources.sinks import paged_report
    _, total = paged_report(R.sales_summary(ctx.fact), "reporting_sales_summary", page=2, page_size=20)
    return total


@register("e12_refresh_reporting_layer", sql("""
SELECT 'reporting_sales_summary' AS table_name, count(DISTINCT month_year) AS row_count FROM fact
UNION ALL SELECT 'reporting_category_summary', count(DISTINCT COALESCE(product_category_name_english, 'Uncategorized'))
  FROM enriched
UNION ALL SELECT 'reporting_state_summary', count(DISTINCT state_code) FROM enriched WHERE state_code IS NOT NULL
UNION ALL SELECT 'reporting_customer_summary', count(DISTINCT customer_unique_id) FROM enriched
  WHERE customer_unique_id IS NOT NULL"""))
def e12(ctx):
    counts = R.refresh_reporting_layer(ctx, ctx.scratch("e12_reporting"))
    return ctx.spark.createDataFrame(sorted(counts.items()), "table_name string, row_count long")


@register("e12_refreshed_contents", sql("""
SELECT 'reporting_sales_summary' AS table_name, month_year AS key, CAST(sum(total_sales_amount) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders FROM fact GROUP BY 2
UNION ALL SELECT 'reporting_category_summary', COALESCE(product_category_name_english, 'Uncategorized'),
       CAST(sum(total_sales_amount) AS DOUBLE), count(DISTINCT order_id) FROM enriched GROUP BY 2
UNION ALL SELECT 'reporting_state_summary', state_code, CAST(sum(total_sales_amount) AS DOUBLE), count(DISTINCT order_id)
  FROM enriched WHERE state_code IS NOT NULL GROUP BY 2
UNION ALL SELECT 'reporting_customer_summary', customer_unique_id, CAST(sum(total_sales_amount) AS DOUBLE),
       count(DISTINCT order_id) FROM enriched WHERE customer_unique_id IS NOT NULL GROUP BY 2"""))
def e12c(ctx):
    """The published tables of a second refresh, row by row."""
    from functools import reduce

    from pyspark.sql import functions as F

    from ..sources import versions
    base = ctx.scratch("e12_contents")
    for _ in range(2):
        R.refresh_reporting_layer(ctx, base)
    keys = {"reporting_sales_summary": ("order_month", "total_revenue"),
            "reporting_category_summary": ("product_category", "total_revenue"),
            "reporting_state_summary": ("state_code", "total_revenue"),
            "reporting_customer_summary": ("customer_unique_id", "lifetime_revenue")}
    return reduce(lambda a, b: a.unionByName(b), [
        versions.read_current(ctx.spark, base, t).select(F.lit(t).alias("table_name"), F.col(k).alias("key"),
                                                         F.col(m).alias("revenue"), F.col("total_orders").alias("orders"))
        for t, (k, m) in keys.items()])
