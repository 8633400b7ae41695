"""A and B registrations: sources, dimensions, keys, fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import warehouse as W
from .registry import register, source_sql, sql

GEO_KEYED = """geo_k AS (SELECT row_number() OVER (ORDER BY zip_code_prefix) AS geography_key, *
                          FROM dim_geography)"""


# --- A1 / A2: the sources themselves -------------------------------------------------
@register("a2_load_all_sources", sql("""
SELECT 'customers' AS source, count(*) AS row_count FROM src_customers
UNION ALL SELECT 'orders', count(*) FROM src_orders
UNION ALL SELECT 'order_items', count(*) FROM src_items
UNION ALL SELECT 'products', count(*) FROM src_products
UNION ALL SELECT 'sellers', count(*) FROM src_sellers
UNION ALL SELECT 'payments', count(*) FROM src_payments
UNION ALL SELECT 'reviews', count(*) FROM src_reviews
UNION ALL SELECT 'geolocation', count(*) FROM src_geo
UNION ALL SELECT 'categories', count(*) FROM categories"""))
def a2(ctx):
    from functools import reduce
    parts = [df.agg(F.count(F.lit(1)).cast("long").alias("row_count")).select(F.lit(n).alias("source"), "row_count")
             for n, df in csv_sources(ctx).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _written_csv(ctx, name: str) -> str:
    """The folder of the CSV sources, with the source ``name`` written there, columns in another order."""
    base = ctx.scratch("csv_sources")

    def build():
        df = ctx.src[name]
        (df.select(*reversed(df.columns)).write.mode("overwrite").option("header", True)
         .option("quote", '"').option("escape", '"').csv(f"{base}/{name}.csv"))
        return base
    return ctx.memo(f"csv_source_{name}", build)


def csv_source(ctx, name: str):
    """One source written as CSV and read back by its loader."""
    from ..sources.csv import load_source
    return load_source(ctx.spark, _written_csv(ctx, name), name)


def csv_sources(ctx):
    """The nine sources written as CSV and read back by the loaders."""
    from ..sources.csv import load_all_sources
    for name in ctx.src:
        base = _written_csv(ctx, name)
    return load_all_sources(ctx.spark, base)


def _source_query(name):
    @register(f"a1_{name}_source", sql(f"SELECT * FROM {source_sql(name)} t"))
    def a1(ctx):
        return csv_source(ctx, name)


for _name in ("customers", "orders", "order_items", "products", "sellers", "payments", "reviews", "geolocation",
              "categories"):
    _source_query(_name)


# --- B1-B5 ---------------------------------------------------------------------------
@register("b1_dim_geography", sql("""
SELECT zip_code_prefix, city_name, state_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM dim_geography"""))
def b1(ctx):
    g = W.dim_geography(ctx.src["geolocation"])
    return g.withColumn("latitude", F.round("latitude", 6)).withColumn("longitude", F.round("longitude", 6))


@register("b2_dim_customer", sql("""
SELECT row_number() OVER (ORDER BY c.customer_id) AS customer_key, c.customer_id, c.customer_unique_id,
       g.geography_key
FROM src_customers c LEFT JOIN geo_k g ON c.zip = g.zip_code_prefix""", GEO_KEYED))
def b2(ctx):
    return ctx.keyed_dims["dim_customer"]


@register("b3_dim_seller", sql("""
SELECT row_number() OVER (ORDER BY s.seller_id) AS seller_key, s.seller_id, g.geography_key
FROM src_sellers s LEFT JOIN geo_k g ON s.seller_zip_code_prefix = g.zip_code_prefix""", GEO_KEYED))
def b3(ctx):
    return ctx.keyed_dims["dim_seller"]


@register("b4_dim_product", sql("""
SELECT row_number() OVER (ORDER BY p.product_id) AS product_key, p.product_id, p.product_category_name,
       c.product_category_name_english, p.product_name_lenght AS product_name_length,
       p.product_description_lenght AS product_description_length, p.product_photos_qty,
       p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
       p.product_length_cm * p.product_height_cm * p.product_width_cm AS product_volume_cm3
FROM src_products p LEFT JOIN categories c ON p.product_category_name = c.product_category_name"""))
def b4(ctx):
    return ctx.keyed_dims["dim_product"]


@register("b5_dim_date", sql("""
SELECT full_date, CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key,
       CAST(day(full_date) AS INTEGER) AS day_number, strftime(full_date, '%A') AS day_name,
       CAST(weekofyear(full_date) AS INTEGER) AS week_number, CAST(month(full_date) AS INTEGER) AS month_number,
       strftime(full_date, '%B') AS month_name, strftime(full_date, '%b') AS month_short_name,
       strftime(full_date, '%Y-%m') AS month_year, CAST(quarter(full_date) AS INTEGER) AS quarter_number,
       'Q' || CAST(quarter(full_date) AS VARCHAR) AS quarter_name,
       CAST(year(full_date) AS VARCHAR) || 'Q' || CAST(quarter(full_date) AS VARCHAR) AS quarter_label,
       CAST(year(full_date) AS INTEGER) AS year_number, CAST(dayofyear(full_date) AS INTEGER) AS day_of_year,
       dayofweek(full_date) IN (0, 6) AS is_weekend, day(full_date) = 1 AS is_month_start,
       month(full_date) <> month(full_date + INTERVAL 1 DAY) AS is_month_end
FROM (SELECT CAST(unnest(generate_series(CAST(min(purchase_ts) AS DATE), CAST(max(estimated_ts) AS DATE),
                                          INTERVAL 1 DAY)) AS DATE) AS full_date
      FROM src_orders) d"""))
def b5(ctx):
    return ctx.keyed_dims["dim_date"]


@register("b6_keyed_dimensions", sql("""
SELECT 'dim_geography' AS dimension, count(*) AS row_count, count(*) AS distinct_keys, CAST(1 AS BIGINT) AS min_key,
       count(*) AS max_key FROM dim_geography
UNION ALL SELECT 'dim_customer', count(*), count(*), 1, count(*) FROM src_customers
UNION ALL SELECT 'dim_seller', count(*), count(*), 1, count(*) FROM src_sellers
UNION ALL SELECT 'dim_product', count(*), count(*), 1, count(*) FROM src_products"""))
def b6(ctx):
    from functools import reduce
    keys = {"dim_geography": "geography_key", "dim_customer": "customer_key",
            "dim_seller": "seller_key", "dim_product": "product_key"}
    parts = [ctx.keyed_dims[d].agg(F.count(F.lit(1)).cast("long").alias("row_count"),
                                   F.countDistinct(k).cast("long").alias("distinct_keys"),
                                   F.min(k).cast("long").alias("min_key"), F.max(k).cast("long").alias("max_key"))
             .select(F.lit(d).alias("dimension"), "row_count", "distinct_keys", "min_key", "max_key")
             for d, k in keys.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- B7 / B8 -------------------------------------------------------------------------
@register("b7_aggregate_payments", sql("""
SELECT order_id, CAST(round(sum(payment_value), 2) AS DOUBLE) AS payment_total,
       max(payment_installments) AS payment_installments_max,
       first(payment_type ORDER BY payment_sequential, payment_type, payment_installments, payment_value)
         AS primary_payment_type,
       count(payment_sequential) AS payment_count
FROM src_payments GROUP BY order_id"""))
def b7(ctx):
    return W.aggregate_payments(ctx.src["payments"]).withColumn("payment_total", F.col("payment_total").cast("double"))


@register("b8_aggregate_reviews", sql("""
SELECT order_id, round(avg(review_score), 2) AS review_score_avg,
       count(review_comment_message) AS review_comment_count
FROM src_reviews GROUP BY order_id"""))
def b8(ctx):
    return W.aggregate_reviews(ctx.src["reviews"])


# --- B9-B11, B14 -----------------------------------------------------------------------
FACT_KEYED_SQL = """
SELECT i.order_id, i.order_item_id, c.customer_key, p.product_key, s.seller_key,
       CAST(strftime(o.purchase_ts, '%Y%m%d') AS INTEGER) AS purchase_date_key,
       i.quantity, i.price, i.freight_value, CAST(i.price + i.freight_value AS DECIMAL(13,2)) AS total_sales_amount
FROM items i JOIN src_orders o ON i.order_id = o.order_id
LEFT JOIN (SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS customer_key FROM src_customers) c
  ON o.customer_id = c.customer_id
LEFT JOIN (SELECT seller_id, row_number() OVER (ORDER BY seller_id) AS seller_key FROM src_sellers) s
  ON i.seller_id = s.seller_id
LEFT JOIN (SELECT product_id, row_number() OVER (ORDER BY product_id) AS product_key FROM src_products) p
  ON i.product_id = p.product_id"""


def _fact_sales(ctx):
    return ctx.memo("fact_sales", lambda: ctx._store(W.fact_sales(ctx.src, ctx.keyed_dims), "fact_sales"))


@register("b11_fact_sales", sql(FACT_KEYED_SQL))
def b11(ctx):
    f = _fact_sales(ctx)
    return f.drop("sales_key", "etl_created_at", "etl_updated_at")


@register("b9_key_lookups", sql(f"""
SELECT count(*) AS fact_rows, count(*) FILTER (WHERE customer_key IS NULL) AS missing_customer_key,
       count(*) FILTER (WHERE product_key IS NULL) AS missing_product_key,
       count(*) FILTER (WHERE seller_key IS NULL) AS missing_seller_key,
       count(*) FILTER (WHERE purchase_date_key IS NULL) AS missing_purchase_date_key
FROM ({FACT_KEYED_SQL}) f"""))
def b9(ctx):
    f = _fact_sales(ctx)
    return f.agg(F.count(F.lit(1)).cast("long").alias("fact_rows"),
                 *[F.count_if(F.col(k).isNull()).cast("long").alias(f"missing_{k}")
                   for k in ("customer_key", "product_key", "seller_key", "purchase_date_key")])


@register("b10_measures", sql("""
SELECT count(*) AS items, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(price) AS DOUBLE) AS price,
       CAST(sum(freight_value) AS DOUBLE) AS freight_value,
       CAST(sum(i.price + i.freight_value) AS DOUBLE) AS total_sales_amount
FROM items i"""))
def b10(ctx):
    m = W.measures(ctx.src["order_items"])
    return m.agg(F.count(F.lit(1)).cast("long").alias("items"), F.sum("quantity").cast("long").alias("quantity"),
                 F.sum("price").cast("double").alias("price"),
                 F.sum("freight_value").cast("double").alias("freight_value"),
                 F.sum("total_sales_amount").cast("double").alias("total_sales_amount"))


@register("b14_audit_columns", sql("""
SELECT count(*) AS fact_rows, count(*) AS stamped_rows, count(*) AS distinct_sales_keys FROM items i
JOIN src_orders o ON i.order_id = o.order_id"""))
def b14(ctx):
    f = _fact_sales(ctx)
    return f.agg(F.count(F.lit(1)).cast("long").alias("fact_rows"),
                 F.count_if(F.col("etl_created_at").isNotNull() & F.col("etl_updated_at").isNotNull())
                 .cast("long").alias("stamped_rows"),
                 F.countDistinct("sales_key").cast("long").alias("distinct_sales_keys"))


# --- B12 / B13 / B15 ---------------------------------------------------------------------
@register("b12_shipping_ratio", sql("""
SELECT order_id, order_item_id,
       CASE WHEN price + freight_value = 0 THEN NULL
            ELSE CAST(freight_value AS DOUBLE) / CAST(price + freight_value AS DOUBLE) END AS shipping_ratio
FROM fact"""))
def b12(ctx):
    return W.shipping_ratio(ctx.fact, digits=None).select("order_id", "order_item_id", "shipping_ratio")


@register("b13_denormalized_fact_build", sql("SELECT * FROM fact"))
def b13(ctx):
    return ctx.fact


@register("b15_rule_segments", sql("SELECT customer_unique_id, segment FROM segs"))
def b15(ctx):
    io = W.items_with_orders(ctx.src).join(
        W.dim_customer(ctx.src["customers"], W.dim_geography(ctx.src["geolocation"])), "customer_id", "left")
    return W.rule_segments(io.where(F.col("customer_unique_id").isNotNull()), ctx.params)


# --- A3-A6, A8-A10: writes, then the written table read back ------------------------------------
from ..sources import sinks  # noqa: E402

SELLER_KEYED_SQL = """
SELECT row_number() OVER (ORDER BY s.seller_id) AS seller_key, s.seller_id, g.geography_key
FROM src_sellers s LEFT JOIN geo_k g ON s.seller_zip_code_prefix = g.zip_code_prefix"""


@register("a3_read_back_dimension_keys", sql(SELLER_KEYED_SQL, GEO_KEYED))
def a3(ctx):
    path = ctx.scratch("a3_dim_seller")
    sinks.replace_table(ctx.keyed_dims["dim_seller"], path)
    return sinks.read_table(ctx.spark, path)


@register("a4_replace_load", sql(SELLER_KEYED_SQL, GEO_KEYED))
def a4(ctx):
    path = ctx.scratch("a4_dim_seller")
    sinks.load_table(ctx.keyed_dims["dim_seller"], path, delete_first=True)
    sinks.load_table(ctx.keyed_dims["dim_seller"], path, delete_first=True)   # replaced, not doubled
    return sinks.read_table(ctx.spark, path)


@register("a5_append_load", sql(f"{SELLER_KEYED_SQL} UNION ALL {SELLER_KEYED_SQL}", GEO_KEYED))
def a5(ctx):
    path = ctx.scratch("a5_dim_seller")
    sinks.load_table(ctx.keyed_dims["dim_seller"], path, delete_first=True)
    sinks.load_table(ctx.keyed_dims["dim_seller"], path, delete_first=False)  # appended
    return sinks.read_table(ctx.spark, path)


@register("a6_warehouse_reset", lambda p: """
SELECT * FROM (VALUES ('dim_customer', CAST(0 AS BIGINT), true), ('dim_date', CAST(0 AS BIGINT), true),
  ('dim_geography', CAST(0 AS BIGINT), true), ('dim_product', CAST(0 AS BIGINT), true),
  ('dim_seller', CAST(0 AS BIGINT), true), ('fact_sales', CAST(0 AS BIGINT), true)) t(table_name, row_count, schema_kept)""")
def a6(ctx):
    """All six tables written, then emptied children first; each keeps its columns."""
    from functools import reduce
    base = ctx.scratch("a6_warehouse")
    tables = {**{n: ctx.keyed_dims[n] for n in sinks.REFERS_TO if n != "fact_sales"}, "fact_sales": ctx.fact}
    for name, df in tables.items():
        sinks.replace_table(df, f"{base}/{name}")
    sinks.reset_warehouse(ctx.spark, base)
    left = {n: sinks.read_table(ctx.spark, f"{base}/{n}") for n in tables}
    parts = [d.agg(F.count(F.lit(1)).cast("long").alias("row_count")).select(
        F.lit(n).alias("table_name"), "row_count", F.lit(d.columns == tables[n].columns).alias("schema_kept"))
        for n, d in left.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("a8_report_csv_export", sql("""
SELECT year_number, month_number, month_year AS order_month,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_unique_id) AS total_customers,
       CASE WHEN count(DISTINCT order_id) > 0
            THEN CAST(sum(total_sales_amount) AS DOUBLE) / count(DISTINCT order_id) ELSE 0 END AS average_order_value
FROM fact GROUP BY 1, 2, 3"""))
def a8(ctx):
    from ..operators import reporting as R
    report = R.sales_summary(ctx.fact, ctx.single_orders)
    path = ctx.scratch("a8_export")
    sinks.export_csv(report, "reporting_sales_summary", path)
    return ctx.spark.read.schema(report.schema).option("header", True).csv(path)


@register("a9_stage_metrics", sql("""
SELECT * FROM (VALUES ('geography', (SELECT count(*) FROM src_geo), (SELECT count(*) FROM dim_geography), 0, 'SUCCESS'),
  ('customer', (SELECT count(*) FROM src_customers), (SELECT count(*) FROM src_customers),
   (SELECT count(*) FROM src_customers WHERE zip NOT IN (SELECT zip_code_prefix FROM dim_geography)), 'SUCCESS'),
  ('seller', (SELECT count(*) FROM src_sellers), (SELECT count(*) FROM src_sellers),
   (SELECT count(*) FROM src_sellers WHERE seller_zip_code_prefix NOT IN (SELECT zip_code_prefix FROM dim_geography)),
   'SUCCESS'),
  ('product', (SELECT count(*) FROM src_products), (SELECT count(*) FROM src_products),
   (SELECT count(*) FROM dim_product WHERE product_category_name_english IS NULL), 'SUCCESS'),
  ('date', (SELECT count(*) FROM src_orders),
   (SELECT count(*) FROM (SELECT unnest(generate_series(CAST(min(purchase_ts) AS DATE), CAST(max(estimated_ts) AS DATE),
                                                        INTERVAL 1 DAY)) FROM src_orders) d), 0, 'SUCCESS'),
  ('fact', (SELECT count(*) FROM src_items), (SELECT count(*) FROM ioc),
   (SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM src_items JOIN src_orders USING (order_id)
                                                     GROUP BY order_id, order_item_id HAVING count(*) > 1) d), 'SUCCESS'))
  t(stage, rows_extracted, rows_loaded, warnings, status)"""))
def a9(ctx):
    from .warehouse_load import load_warehouse
    m = load_warehouse(ctx, ctx.scratch("a9_warehouse"))
    return m.select("stage", "rows_extracted", "rows_loaded", "warnings", "status")   # seconds vary by run


from .q_segmentation import ssql  # noqa: E402


@register("a10_write_persona_table", ssql("""
SELECT customer_unique_id, cluster_id, persona, round(distance_to_center, 6) AS distance_to_center,
       round(confidence_score, 6) AS confidence_score FROM rp"""))
def a10(ctx):
    from pyspark.sql import functions as F
    from .q_segmentation import rule_personas
    path = ctx.scratch("a10_customer_segment_ml")
    sinks.replace_table(rule_personas(ctx).select("customer_unique_id", "cluster_id", "persona",
                                                  "distance_to_center", "confidence_score"), path)
    t = sinks.read_table(ctx.spark, path)
    return t.select("customer_unique_id", "cluster_id", "persona",
                    F.round("distance_to_center", 6).alias("distance_to_center"),
                    F.round("confidence_score", 6).alias("confidence_score"))
