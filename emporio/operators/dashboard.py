"""Parameterised dashboard queries.

One logical definition per query; the table that answers it is chosen by
``cubes.source`` (F2) from the dimensions it filters and groups by and the
measures it needs.  Every table gives the same answer; ``using`` names one
(tests/test_dashboard.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..functions.filters import Slice
from .cubes import candidates, source
from .reporting import money, n_distinct, n_rows, ratio

ORDER_ATTRS = {"month", "state", "segment"}


# --- F2 ------------------------------------------------------------------------------
def uses_order_table(s: Slice) -> bool:
    return set(s.active()) <= ORDER_ATTRS


def roll_up_orders(items: DataFrame) -> DataFrame:
    return (items.groupBy("order_id")
            .agg(F.max("customer_unique_id").alias("customer_unique_id"),
                 F.max("segment").alias("segment"),
                 F.max("state_code").alias("state_code"),
                 F.max("month_year").alias("month_year"),
                 F.sum("total_sales_amount").alias("revenue"),
                 F.sum("quantity").cast("long").alias("quantity"),
                 F.sum("freight_value").alias("freight")))


def order_source(ctx, s: Slice) -> DataFrame:
    """Order-grain rows of the slice (F2 routing)."""
    if "seller" in s.active():
        return roll_up_orders(s.apply(ctx.fact))
    if "category" in s.active():   # one category: a row per order there too
        return s.apply(ctx.cube("order_categories"))
    return s.apply(ctx.orders)


def n_orders() -> Column:
    return F.coalesce(F.sum("orders"), F.lit(0)).cast("long")


def customer_totals(ctx, s: Slice, using: str | None = None) -> DataFrame:
    """Customer grain of a slice: lifetime revenue, orders, items."""
    question = s, {"customer"}, {"revenue", "orders", "quantity"}
    rows = source(ctx, *question, using)
    if (using or candidates(*question)[0]) == "customers":   # a row per customer already
        return rows.select("customer_unique_id", F.col("revenue").alias("lifetime_revenue"),
                           F.col("orders").alias("order_count"), F.col("quantity").alias("total_items"))
    return (rows.groupBy("customer_unique_id")
            .agg(F.sum("revenue").alias("lifetime_revenue"), n_orders().alias("order_count"),
                 F.sum("quantity").cast("long").alias("total_items")))


# --- F3 / F9 ------------------------------------------------------------------------------
def overall_kpis(ctx, s: Slice = Slice(), using: str | None = None) -> DataFrame:
    o = source(ctx, s, set(), {"revenue", "orders", "customers"}, using)
    return (o.agg(F.coalesce(money("revenue"), F.lit(0.0)).alias("total_revenue"),
                  n_orders().alias("total_orders"),
                  n_distinct("customer_unique_id").alias("total_customers"))
             .withColumn("average_order_value", ratio(F.col("total_revenue"), F.col("total_orders"))))


def sales_kpis(ctx, s: Slice = Slice(), using: str | None = None) -> DataFrame:
    o = source(ctx, s, set(), {"revenue", "orders"}, using)
    return (o.agg(F.coalesce(money("revenue"), F.lit(0.0)).alias("total_revenue"), n_orders().alias("total_orders"))
             .withColumn("average_order_value", ratio(F.col("total_revenue"), F.col("total_orders"))))


# --- F4 / F5 + G1 ---------------------------------------------------------------------------
def month_spine(months: DataFrame) -> DataFrame:
    """Every month between the first and last month present (one row per month).

    The bounds are a global min/max; the spine has as many rows as months
    in the range, so the explode runs in one small task whatever the data.
    """
    first_day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    b = months.agg(F.min("month_year").alias("lo"), F.max("month_year").alias("hi"))
    return (b.where(F.col("lo").isNotNull())
             .select(F.explode(F.sequence(first_day(F.col("lo")), first_day(F.col("hi")),
                                          F.expr("INTERVAL 1 MONTH"))).alias("d"))
             .select(F.date_format("d", "yyyy-MM").alias("order_month")))


def growth_pct(cur: Column, prev: Column) -> Column:
    """G1: (cur - prev) / prev * 100; NULL when prev is 0 or NULL."""
    return F.when(prev.isNull() | (prev == 0), F.lit(None).cast("double")) \
            .otherwise((cur - prev) / prev * 100.0)


def monthly_trend(ctx, s: Slice = Slice(), honour_month: bool = False,
                  with_customers: bool = True, using: str | None = None) -> DataFrame:
    """F4 (month filter ignored) / F5 (month filter honoured, no customers).

    Gap-free: months without sales show zeros.  Adds MoM revenue growth.
    """
    if not honour_month:
        s = s.without("month")
    o = source(ctx, s, {"month"}, {"revenue", "orders", *(["customers"] if with_customers else [])}, using)
    aggs = [money("revenue").alias("total_revenue"), n_orders().alias("total_orders")]
    if with_customers:
        aggs.append(n_distinct("customer_unique_id").alias("total_customers"))
    m = o.groupBy(F.col("month_year").alias("order_month")).agg(*aggs)
    spine = month_spine(o)
    out = spine.join(m, "order_month", "left")
    cols = [F.col("order_month"),
            F.substring("order_month", 1, 4).cast("int").alias("year_number"),
            F.substring("order_month", 6, 2).cast("int").alias("month_number"),
            F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
            F.coalesce("total_orders", F.lit(0).cast("long")).alias("total_orders")]
    if with_customers:
        cols.append(F.coalesce("total_customers", F.lit(0).cast("long")).alias("total_customers"))
    cols.append(ratio(F.coalesce("total_revenue", F.lit(0.0)),
                      F.coalesce("total_orders", F.lit(0))).alias("average_order_value"))
    out = out.select(*cols)
    w = Window.orderBy("order_month")   # one row per month: a small single-partition frame
    return out.withColumn("revenue_growth_pct",
                          growth_pct(F.col("total_revenue"), F.lag("total_revenue").over(w)))


# --- F6 / F10 / F16 ------------------------------------------------------------------------------
def category_performance(ctx, s: Slice = Slice(), limit: int | None = None, using: str | None = None) -> DataFrame:
    """Per category: revenue, orders, customers, items, average item price.

    Top-N is ordered by revenue then name (a unique tie-break).
    """
    f = source(ctx, s, {"category"}, {"revenue", "orders", "customers", "quantity"}, using)
    out = (f.groupBy(F.col("product_category_name_english").alias("product_category"))
           .agg(money("revenue").alias("total_revenue"), n_orders().alias("total_orders"),
                n_distinct("customer_unique_id").alias("total_customers"),
                F.sum("quantity").cast("long").alias("total_items_sold"))
           .withColumn("average_item_price", ratio(F.col("total_revenue"), F.col("total_items_sold"))))
    if limit is not None:
        out = out.orderBy(F.desc("total_revenue"), F.asc("product_category")).limit(limit)
    return out


def top_categories(ctx, s: Slice = Slice(), params: Params = Params()) -> DataFrame:
    return category_performance(ctx, s, params.top_n_categories)


# --- F7 / F11 / F18 / F19 --------------------------------------------------------------------------
def state_performance(ctx, s: Slice = Slice(), limit: int | None = None, using: str | None = None) -> DataFrame:
    o = source(ctx, s, {"state"}, {"revenue", "orders", "customers", "freight"}, using)
    out = (o.groupBy("state_code")
           .agg(money("revenue").alias("total_revenue"), n_orders().alias("total_orders"),
                n_distinct("customer_unique_id").alias("total_customers"),
                money("freight").alias("total_freight_cost")))
    if limit is not None:
        out = out.orderBy(F.desc("total_revenue"), F.asc("state_code")).limit(limit)
    return out


def top_states(ctx, s: Slice = Slice(), params: Params = Params()) -> DataFrame:
    return state_performance(ctx, s, params.top_n_states)


def sales_by_state(ctx, s: Slice = Slice(), params: Params = Params(), using: str | None = None) -> DataFrame:
    o = source(ctx, s, {"state"}, {"revenue", "orders"}, using)
    return (o.groupBy("state_code").agg(money("revenue").alias("total_revenue"), n_orders().alias("total_orders"))
             .orderBy(F.desc("total_revenue"), F.asc("state_code")).limit(params.top_n_sales_states))


def all_states(ctx, s: Slice = Slice()) -> DataFrame:
    """every state; the state filter is ignored (the map shows all)."""
    return state_performance(ctx, s.without("state"))


def state_totals(ctx, s: Slice = Slice()) -> DataFrame:
    o = order_source(ctx, s)
    return o.agg(F.coalesce(money("revenue"), F.lit(0.0)).alias("total_revenue"),
                 n_rows().alias("total_orders"),
                 n_distinct("customer_unique_id").alias("total_customers"),
                 F.coalesce(money("freight"), F.lit(0.0)).alias("total_freight_cost"),
                 n_distinct("state_code").alias("total_states"))


# --- F8 / F12 / F13 / F14 ----------------------------------------------------------------------------
def customer_snapshot(ctx, s: Slice = Slice(), using: str | None = None) -> DataFrame:
    c = customer_totals(ctx, s, using)
    return c.agg(F.coalesce(F.sum(F.when(F.col("order_count") > 1, 1).otherwise(0)), F.lit(0))
                 .cast("long").alias("repeat_customers"),
                 F.coalesce(F.sum(F.when(F.col("order_count") == 1, 1).otherwise(0)), F.lit(0))
                 .cast("long").alias("one_time_customers"),
                 n_rows().alias("total_customers"))


def customer_overview(ctx, s: Slice = Slice(), using: str | None = None) -> DataFrame:
    c = customer_totals(ctx, s, using)
    return c.agg(n_rows().alias("total_customers"),
                 F.count_if(F.col("order_count") > 1).cast("long").alias("repeat_customers"),
                 F.count_if(F.col("order_count") == 1).cast("long").alias("one_time_customers"),
                 (F.sum("lifetime_revenue").cast("double") / F.count("lifetime_revenue"))
                 .alias("avg_lifetime_spend"),
                 (F.sum("order_count").cast("double") / F.count("order_count")).alias("avg_orders"))


def tier_column(spend: Column, params: Params) -> tuple[Column, Column]:
    """(label, ordinal) of the spending tier; edges are parameters."""
    labels = params.tier_labels()
    label, idx = None, None
    for i, edge in enumerate(params.tier_edges):
        cond = spend < F.lit(edge)
        label = F.when(cond, labels[i]) if label is None else label.when(cond, labels[i])
        idx = F.when(cond, i) if idx is None else idx.when(cond, i)
    return label.otherwise(labels[-1]), idx.otherwise(len(labels) - 1)


def spending_tiers(ctx, s: Slice = Slice(), params: Params = Params(), using: str | None = None) -> DataFrame:
    """customers per spend tier, ordered by the tier's smallest spend."""
    c = customer_totals(ctx, s, using)
    label, _ = tier_column(F.col("lifetime_revenue"), params)
    return (c.groupBy(label.alias("tier"))
            .agg(n_rows().alias("customer_count"),
                 money("lifetime_revenue").alias("tier_revenue"),
                 (F.sum("lifetime_revenue").cast("double") / F.count("lifetime_revenue")).alias("avg_spend"),
                 F.min("lifetime_revenue").cast("double").alias("min_spend")))


def top_customers(ctx, s: Slice = Slice(), params: Params = Params(), using: str | None = None) -> DataFrame:
    c = customer_totals(ctx, s, using)
    return (c.select("customer_unique_id",
                     F.col("lifetime_revenue").cast("double").alias("lifetime_revenue"),
                     F.col("order_count").alias("total_orders"),
                     F.col("total_items").alias("total_items"),
                     ratio(F.col("lifetime_revenue"), F.col("order_count")).alias("average_order_value"),
                     (F.col("order_count") > 1).cast("int").alias("is_repeat_customer"))
             .orderBy(F.desc("lifetime_revenue"), F.asc("customer_unique_id"))
             .limit(params.top_n_customers))


# --- F17 ---------------------------------------------------------------------------------------------
def seller_ranking(ctx, s: Slice = Slice(), limit: int | None = 20, using: str | None = None) -> DataFrame:
    f = source(ctx, s, {"seller"}, {"revenue", "orders", "quantity"}, using, known=frozenset({"seller"}))
    out = (f.where(F.col("seller_id") != "unknown").groupBy("seller_id")
           .agg(F.max("seller_city").alias("seller_city"), F.max("seller_state").alias("seller_state"),
                n_orders().alias("total_orders"),
                F.sum("quantity").cast("long").alias("total_items"),
                money("revenue").alias("total_revenue")))
    if limit is not None:
        out = out.orderBy(F.desc("total_revenue"), F.asc("seller_id")).limit(limit)
    return out


# --- F25 ---------------------------------------------------------------------------------------------
def cube_slice(ctx, s: Slice = Slice(), using: str | None = None) -> DataFrame:
    """sums of a month x state x category x segment slice (one row)."""
    o = source(ctx, s, set(), {"revenue", "orders", "customers", "quantity"}, using)
    return o.agg(money("revenue").alias("total_revenue"), n_orders().alias("total_orders"),
                 n_distinct("customer_unique_id").alias("total_customers"),
                 F.sum("quantity").cast("long").alias("total_items_sold"))


# --- F21 / F23 / F24 -----------------------------------------------------------------------------------
def customer_categories(ctx, customer_unique_id: str) -> DataFrame:
    """distinct categories a customer bought, ordered."""
    return (ctx.fact.where(F.col("customer_unique_id") == customer_unique_id)
            .select(F.col("product_category_name_english").alias("product_category"))
            .where(F.col("product_category").isNotNull())
            .distinct().orderBy("product_category"))


def filter_options(ctx, top_sellers: int = 100) -> DataFrame:
    """the lists behind the filter drop-downs, as (kind, value, rank)."""
    f = ctx.fact
    cats = (f.where(F.col("product_category_name_english") != "unknown")
             .select(F.lit("category").alias("kind"), F.col("product_category_name_english").alias("value"))
             .distinct())
    states = (f.where(F.col("state_code") != "unknown")
               .select(F.lit("state").alias("kind"), F.col("state_code").alias("value")).distinct())
    months = f.select(F.lit("month").alias("kind"), F.col("month_year").alias("value")).distinct()
    sellers = (f.where(F.col("seller_id") != "unknown").groupBy("seller_id")
                .agg(F.sum("total_sales_amount").alias("rev"))
                .orderBy(F.desc("rev"), F.asc("seller_id")).limit(top_sellers)
                .select(F.lit("seller").alias("kind"), F.col("seller_id").alias("value")))
    return cats.unionByName(states).unionByName(months).unionByName(sellers)


def search(ctx, q: str, n_categories: int = 5, n_states: int = 3) -> DataFrame:
    """case-insensitive substring search over categories and states.

    Queries shorter than two characters return nothing.
    """
    q = (q or "").strip().lower()
    f = ctx.fact
    cats = (f.select(F.col("product_category_name_english").alias("value"))
             .where(F.col("value") != "unknown").distinct()
             .where(F.lower("value").contains(q) & F.lit(len(q) >= 2))
             .orderBy("value").limit(n_categories).select(F.lit("category").alias("kind"), "value"))
    states = (f.select(F.col("state_code").alias("value"))
               .where(F.col("value") != "unknown").distinct()
               .where(F.lower("value").contains(q) & F.lit(len(q) >= 2))
               .orderBy("value").limit(n_states).select(F.lit("state").alias("kind"), "value"))
    return cats.unionByName(states)
