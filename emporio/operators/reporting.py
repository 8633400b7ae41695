"""Reporting views, summary tables and pre-aggregated cubes.

All are single GROUP BYs over the item-grain fact (``enriched`` keeps
NULL dimension attributes for the SQL-view semantics, ``fact`` has the
'unknown' defaults).  Money is summed as DECIMAL (exact) and returned as
DOUBLE; averages are sum / count so every engine gets the same bits.
Spark plans each as partial aggregate -> shuffle on the group key ->
final aggregate; distinct counts add a (key, value) shuffle level, so a
hot group is spread over many reducers instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Slice
from ..functions.order_rows import order_rows


def money(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).cast("double")


def n_distinct(col: str) -> Column:
    return F.countDistinct(col).cast("long")


def n_rows() -> Column:
    return F.count(F.lit(1)).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, 0 when den is 0 (CASE WHEN den > 0 ... ELSE 0)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def by_orders(rows: DataFrame, by: list, customer: str = "customer_unique_id", single: bool = False) -> DataFrame:
    """A row per group and order: revenue, quantity, freight and the order's customer.

    Order counts are then row counts, and one distinct count is left,
    which needs no copy of the rows.  ``single`` as in ``order_rows``.
    """
    sums = {"revenue": F.sum("total_sales_amount"), "quantity": F.sum("quantity").cast("long"), "freight": F.sum("freight_value")}
    return order_rows(rows.withColumn("customer", F.col(customer)), [*by, "order_id"], ["customer"], sums, single)


# --- E1 ---------------------------------------------------------------------------
def sales_summary(fact: DataFrame, single: bool = False) -> DataFrame:
    """reporting_sales_summary: month -> revenue, orders, customers, AOV."""
    by = ["year_number", "month_number", "order_month"]
    return (by_orders(fact.withColumn("order_month", F.col("month_year")), by, single=single).groupBy(*by)
            .agg(money("revenue").alias("total_revenue"), n_rows().alias("total_orders"),
                 n_distinct("customer").alias("total_customers"))
            .withColumn("average_order_value", ratio(F.col("total_revenue"), F.col("total_orders"))))


# --- E2 / E3 ----------------------------------------------------------------------------
def category_summary(enriched: DataFrame) -> DataFrame:
    """reporting_category_summary (SQL variant): NULL -> 'Uncategorized', AVG(price)."""
    cat = F.coalesce(F.col("product_category_name_english"), F.lit("Uncategorized"))
    return (enriched.groupBy(cat.alias("product_category"))
            .agg(money("total_sales_amount").alias("total_revenue"),
                 n_distinct("order_id").alias("total_orders"),
                 n_rows().alias("total_items_sold"),
                 (F.sum("price").cast("double") / F.count("price")).alias("average_item_price")))


def category_summary_denorm(fact: DataFrame) -> DataFrame:
    """Denormalised variant: 'unknown' kept, average = revenue / quantity."""
    return (fact.where(F.col("product_category_name_english").isNotNull())
            .groupBy(F.col("product_category_name_english").alias("product_category"))
            .agg(money("total_sales_amount").alias("total_revenue"),
                 n_distinct("order_id").alias("total_orders"),
                 F.sum("quantity").cast("long").alias("total_items_sold"))
            .withColumn("average_item_price", ratio(F.col("total_revenue"), F.col("total_items_sold"))))


# --- E4 / E5 -------------------------------------------------------------------------------
def state_summary(enriched: DataFrame, single: bool = False) -> DataFrame:
    """reporting_state_summary: inner joins -> customers without geography drop out."""
    return (by_orders(enriched.where(F.col("state_code").isNotNull()), ["state_code"], single=single).groupBy("state_code")
            .agg(money("revenue").alias("total_revenue"), n_rows().alias("total_orders"),
                 n_distinct("customer").alias("total_customers"), money("freight").alias("total_freight_cost")))


def state_summary_denorm(fact: DataFrame, single: bool = False) -> DataFrame:
    """Denormalised variant: LEFT(state, 2) over codes of length 2 ('unknown' drops)."""
    return (by_orders(fact.where(F.col("state_code").isNotNull() & (F.length("state_code") == 2)), ["state_code"], single=single)
            .groupBy("state_code")
            .agg(money("revenue").alias("total_revenue"), n_rows().alias("total_orders"),
                 n_distinct("customer").alias("total_customers"), money("freight").alias("total_freight_cost")))


# --- E6 ---------------------------------------------------------------------------------------
def customer_summary(enriched: DataFrame) -> DataFrame:
    """reporting_customer_summary: lifetime revenue, orders, items, AOV, repeat flag."""
    return (enriched.where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id")
            .agg(money("total_sales_amount").alias("lifetime_revenue"),
                 n_distinct("order_id").alias("total_orders"),
                 n_rows().alias("total_items_purchased"))
            .withColumn("average_order_value", ratio(F.col("lifetime_revenue"), F.col("total_orders")))
            .withColumn("is_repeat_customer", (F.col("total_orders") > 1).cast("int")))


# --- E8-E11 -------------------------------------------------------------------------------------
def sales_by_category(enriched: DataFrame) -> DataFrame:
    """vw_sales_by_category."""
    cat = F.coalesce(F.col("product_category_name_english"), F.lit("Uncategorized"))
    return (enriched.groupBy(cat.alias("product_category"))
            .agg(n_rows().alias("total_items_sold"),
                 n_distinct("order_id").alias("total_orders"),
                 money("price").alias("total_item_revenue"),
                 money("freight_value").alias("total_freight_revenue"),
                 money("total_sales_amount").alias("total_gross_revenue"),
                 (F.sum("price").cast("double") / F.count("price")).alias("avg_item_price")))


def customer_rfm_summary(enriched: DataFrame) -> DataFrame:
    """vw_customer_rfm_summary: customer x state x city (LEFT geography)."""
    return (enriched.where(F.col("customer_unique_id").isNotNull())
            .groupBy("customer_unique_id", F.col("state_code").alias("customer_state"),
                     F.col("customer_city"))
            .agg(n_distinct("order_id").alias("total_orders_placed"),
                 n_rows().alias("total_items_purchased"),
                 money("total_sales_amount").alias("total_lifetime_spend"),
                 (F.sum("total_sales_amount").cast("double") / F.count("total_sales_amount"))
                 .alias("avg_order_item_spend"),
                 F.max("order_date").alias("most_recent_purchase_date")))


def monthly_revenue_trend(enriched: DataFrame) -> DataFrame:
    """vw_monthly_revenue_trend."""
    return (enriched.groupBy("year_number", "month_number", "month_year")
            .agg(n_distinct("order_id").alias("monthly_orders"),
                 n_rows().alias("monthly_items_sold"),
                 money("price").alias("monthly_item_revenue"),
                 money("freight_value").alias("monthly_freight_revenue"),
                 money("total_sales_amount").alias("monthly_gross_revenue"),
                 (F.sum("total_sales_amount").cast("double") / F.count("total_sales_amount"))
                 .alias("monthly_avg_item_value")))


def seller_performance(enriched: DataFrame) -> DataFrame:
    """vw_seller_performance (also the stored reporting_seller_summary, E7)."""
    return (enriched.where(F.col("seller_id").isNotNull())
            .groupBy("seller_id", "seller_state", "seller_city")
            .agg(n_distinct("order_id").alias("orders_fulfilled"),
                 n_rows().alias("items_sold"),
                 money("price").alias("gross_item_revenue"),
                 money("freight_value").alias("freight_generated"),
                 money("total_sales_amount").alias("total_revenue_generated")))


# --- E13-E16 --------------------------------------------------------------------------------------
def _filter_measures(with_customers: bool = True, with_freight: bool = True) -> list[Column]:
    out = [money("total_sales_amount").alias("total_revenue"),
           n_distinct("order_id").alias("total_orders")]
    if with_customers:
        out.append(n_distinct("customer_id").alias("total_customers"))
    out.append(F.sum("quantity").cast("long").alias("total_items_sold"))
    if with_freight:
        out.append(money("freight_value").alias("total_freight"))
    return out


def _order_measures() -> list[Column]:
    return [money("revenue").alias("total_revenue"), n_rows().alias("total_orders"),
            n_distinct("customer").alias("total_customers"), F.sum("quantity").cast("long").alias("total_items_sold"),
            money("freight").alias("total_freight")]


def filter_monthly(fact: DataFrame, single: bool = False) -> DataFrame:
    """reporting_filter_monthly: segment x state x month."""
    by = ["segment", "state_code", "month_year", "year_number", "month_number"]
    return by_orders(fact, by, "customer_id", single).groupBy(*by).agg(*_order_measures())


def filter_totals(fact: DataFrame, single: bool = False) -> DataFrame:
    """reporting_filter_totals: segment x state."""
    by = ["segment", "state_code"]
    return by_orders(fact, by, "customer_id", single).groupBy(*by).agg(*_order_measures())


def filter_categories(fact: DataFrame) -> DataFrame:
    """reporting_filter_categories: segment x category."""
    return (fact.groupBy("segment", F.col("product_category_name_english").alias("product_category"))
            .agg(*_filter_measures(with_customers=False, with_freight=False)))


def filter_grouping_sets(fact: DataFrame) -> DataFrame:
    """E13-E15 in one scan: GROUPING SETS over the same measures.

    One read of the fact and one shuffle instead of three; rows of the
    three tables are told apart by ``grouping_id``.
    """
    return fact.sparkSession.sql("""
        SELECT segment, state_code, month_year, product_category_name_english AS product_category,
               grouping_id(segment, state_code, month_year, product_category_name_english) AS gid,
               CAST(SUM(total_sales_amount) AS DOUBLE) AS total_revenue,
               COUNT(DISTINCT order_id) AS total_orders,
               COUNT(DISTINCT customer_id) AS total_customers,
               CAST(SUM(quantity) AS BIGINT) AS total_items_sold,
               CAST(SUM(freight_value) AS DOUBLE) AS total_freight
        FROM {fact}
        GROUP BY GROUPING SETS ((segment, state_code, month_year), (segment, state_code),
                                (segment, product_category_name_english))""", fact=fact)


def filter_customer_orders(fact: DataFrame) -> DataFrame:
    """reporting_filter_customer_orders (E16): customer -> lifetime numbers."""
    return (fact.groupBy("customer_unique_id")
            .agg(money("total_sales_amount").alias("lifetime_revenue"),
                 n_distinct("order_id").alias("order_count"),
                 F.sum("quantity").cast("long").alias("total_items"),
                 F.max("segment").alias("segment"),
                 F.max("state_code").alias("state_code")))


# --- E17-E19 ----------------------------------------------------------------------------------------
def exec_orders(fact: DataFrame) -> DataFrame:
    """rpt_exec_orders: one row per order."""
    return (fact.groupBy("order_id")
            .agg(F.max("customer_unique_id").alias("customer_unique_id"),
                 F.max("segment").alias("segment"),
                 F.max("state_code").alias("state_code"),
                 F.max("month_year").alias("month_year"),
                 money("total_sales_amount").alias("revenue"),
                 F.sum("quantity").cast("long").alias("quantity"),
                 money("freight_value").alias("freight")))


def cube_ssc(fact: DataFrame) -> DataFrame:
    """rpt_cube_ssc: segment x state x category (category known)."""
    return (fact.where(F.col("product_category_name_english") != "unknown")
            .groupBy("segment", "state_code", F.col("product_category_name_english").alias("category"))
            .agg(money("total_sales_amount").alias("revenue"),
                 F.sum("quantity").cast("long").alias("quantity"),
                 n_distinct("order_id").alias("orders"),
                 n_distinct("customer_unique_id").alias("customers")))


def cube_seller(fact: DataFrame) -> DataFrame:
    """rpt_cube_seller: segment x state x month x seller (seller known)."""
    return (fact.where(F.col("seller_id") != "unknown")
            .groupBy("segment", "state_code", "month_year", "seller_id")
            .agg(F.max("seller_city").alias("seller_city"),
                 F.max("seller_state").alias("seller_state"),
                 money("total_sales_amount").alias("revenue"),
                 F.sum("quantity").cast("long").alias("quantity"),
                 n_distinct("order_id").alias("orders")))


# --- E20 / E12 ----------------------------------------------------------------------------------------
def staleness(fact: DataFrame, customer_table: DataFrame, orders_table: DataFrame) -> DataFrame:
    """One row telling whether the customer / order summaries must be rebuilt.

    Stale when a table is empty or its row count differs from the
    distinct count in the fact.  Three global aggregates, one row each.
    """
    f = fact.agg(n_distinct("customer_unique_id").alias("fact_customers"),
                 n_distinct("order_id").alias("fact_orders"))
    c = customer_table.agg(n_rows().alias("customer_rows"))
    o = orders_table.agg(n_rows().alias("order_rows"))
    return (f.crossJoin(c).crossJoin(o)   # three one-row frames
            .withColumn("customers_stale", (F.col("customer_rows") == 0)
                        | (F.col("customer_rows") != F.col("fact_customers")))
            .withColumn("orders_stale", (F.col("order_rows") == 0)
                        | (F.col("order_rows") != F.col("fact_orders"))))


REPORTING_TABLES = {
    "reporting_sales_summary": ("fact", sales_summary),
    "reporting_category_summary": ("enriched", category_summary),
    "reporting_state_summary": ("enriched", state_summary),
    "reporting_customer_summary": ("enriched", customer_summary),
}


def refresh_reporting_layer(ctx, out_dir: str) -> dict[str, int]:
    """Rebuild the four summary tables and publish them together.

    They are written as a new version; the manifest names it only when
    all four are there, so a failure in any of them leaves the four old
    ones as they were.  Read them with ``versions.read_current``.
    """
    from ..sources import versions

    def build(source, fn):
        return lambda: fn(ctx.fact if source == "fact" else ctx.enriched)

    return versions.replace_together(ctx.spark, out_dir, {n: build(*t) for n, t in REPORTING_TABLES.items()})
