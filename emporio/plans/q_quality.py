"""C and D registrations: data quality, reconciliation, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling as P
from ..operators import quality as Q
from ..operators import reporting as R
from ..operators import warehouse as W
from .registry import register, source_sql, sql


def _ioc(ctx):
    return W.items_with_orders(ctx.src)


# --- C2-C5 ----------------------------------------------------------------------------
@register("c2_row_count_check", sql("""
SELECT 'row_count' AS check, 'fact_sales' AS dataset, e.expected, a.actual,
       abs(a.actual - e.expected) AS violations,
       CASE WHEN a.actual <> e.expected THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT count(*) AS actual FROM fact) a,
     (SELECT count(*) AS expected FROM src_items i WHERE i.order_id IN (SELECT order_id FROM src_orders)) e"""))
def c2(ctx):
    items = ctx.src["order_items"]
    expected = (items.join(ctx.src["orders"].select("order_id"), "order_id", "left_semi")
                .agg(F.count(F.lit(1)).alias("expected")))
    return Q.row_count_check(ctx.fact, expected, "fact_sales")


@register("c3_grain_uniqueness", sql("""
SELECT 'grain' AS check, 'fact_sales' AS dataset, 'order_id,order_item_id' AS key,
       CAST(COALESCE(sum(cnt), 0) AS BIGINT) AS violations, count(*) AS duplicate_keys,
       CASE WHEN COALESCE(sum(cnt), 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT order_id, order_item_id, count(*) AS cnt FROM fact GROUP BY 1, 2 HAVING count(*) > 1) d"""))
def c3(ctx):
    return Q.grain_check(ctx.fact, ["order_id", "order_item_id"], "fact_sales")


@register("c4_null_keys", sql("""
SELECT 'null_keys' AS check, 'fact_sales' AS dataset, key, violations,
       CASE WHEN violations > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT 'customer_unique_id' AS key, count(*) FILTER (WHERE customer_unique_id IS NULL) AS violations FROM enriched
      UNION ALL SELECT 'product_category_name_english', count(*) FILTER (WHERE product_category_name_english IS NULL) FROM enriched
      UNION ALL SELECT 'state_code', count(*) FILTER (WHERE state_code IS NULL) FROM enriched
      UNION ALL SELECT 'seller_state', count(*) FILTER (WHERE seller_state IS NULL) FROM enriched) t"""))
def c4(ctx):
    return Q.null_key_check(ctx.enriched, ["customer_unique_id", "product_category_name_english",
                                           "state_code", "seller_state"], "fact_sales")


@register("c5_business_rules", sql("""
SELECT 'business_rule' AS check, 'fact_sales' AS dataset, key, violations,
       CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT 'price_non_negative' AS key, count(*) FILTER (WHERE price < 0) AS violations FROM fact
      UNION ALL SELECT 'freight_non_negative', count(*) FILTER (WHERE freight_value < 0) FROM fact
      UNION ALL SELECT 'total_non_negative', count(*) FILTER (WHERE total_sales_amount < 0) FROM fact
      UNION ALL SELECT 'quantity_positive', count(*) FILTER (WHERE quantity <= 0) FROM fact) t"""))
def c5(ctx):
    return Q.business_rules(ctx.fact)


# --- C6-C8 --------------------------------------------------------------------------------
@register("c6_revenue_reconciliation", sql("""
SELECT measure, source_total, fact_total, difference,
       CASE WHEN difference > 0.01 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT 'price' AS measure, CAST(s.sp AS DOUBLE) AS source_total, CAST(f.fp AS DOUBLE) AS fact_total,
             CAST(abs(s.sp - f.fp) AS DOUBLE) AS difference
      FROM (SELECT sum(price) AS sp, sum(freight_value) AS sf FROM src_items) s,
           (SELECT sum(price) AS fp, sum(freight_value) AS ff FROM fact) f
      UNION ALL
      SELECT 'freight', CAST(s.sf AS DOUBLE), CAST(f.ff AS DOUBLE), CAST(abs(s.sf - f.ff) AS DOUBLE)
      FROM (SELECT sum(price) AS sp, sum(freight_value) AS sf FROM src_items) s,
           (SELECT sum(price) AS fp, sum(freight_value) AS ff FROM fact) f) t"""))
def c6(ctx):
    return Q.revenue_reconciliation(ctx.src["order_items"], ctx.fact)


@register("c7_fact_dim_orphans", sql("""
SELECT 'orphans' AS check, dataset, key, violations, CASE WHEN violations > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT 'dim_customer' AS dataset, 'customer_id' AS key,
             (SELECT count(*) FROM ioc WHERE customer_id NOT IN (SELECT customer_id FROM src_customers)) AS violations
      UNION ALL SELECT 'dim_product', 'product_id',
             (SELECT count(*) FROM ioc WHERE product_id NOT IN (SELECT product_id FROM src_products))
      UNION ALL SELECT 'dim_seller', 'seller_id',
             (SELECT count(*) FROM ioc WHERE seller_id NOT IN (SELECT seller_id FROM src_sellers))
      UNION ALL SELECT 'dim_date', 'order_date',
             (SELECT count(*) FROM ioc WHERE CAST(purchase_ts AS DATE) NOT IN (
                 SELECT CAST(unnest(generate_series(CAST(min(purchase_ts) AS DATE), CAST(max(estimated_ts) AS DATE),
                                                    INTERVAL 1 DAY)) AS DATE) FROM src_orders))) t"""))
def c7(ctx):
    from functools import reduce
    io = _ioc(ctx).withColumn("order_date", F.to_date(F.try_to_timestamp("order_purchase_timestamp")))
    checks = [
        Q.orphans(io, ctx.src["customers"], "customer_id", dataset="dim_customer"),
        Q.orphans(io, ctx.src["products"], "product_id", dataset="dim_product"),
        Q.orphans(io, ctx.src["sellers"], "seller_id", dataset="dim_seller"),
        Q.orphans(io, W.dim_date(ctx.src["orders"]), "order_date", "full_date", dataset="dim_date"),
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)


@register("c8_dim_geography_orphans", sql("""
SELECT 'orphans' AS check, dataset, key, violations, CASE WHEN violations > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT 'dim_customer' AS dataset, 'customer_zip_code_prefix' AS key,
             (SELECT count(*) FROM src_customers WHERE zip IS NOT NULL
                AND zip NOT IN (SELECT zip_code_prefix FROM dim_geography)) AS violations
      UNION ALL SELECT 'dim_seller', 'seller_zip_code_prefix',
             (SELECT count(*) FROM src_sellers WHERE seller_zip_code_prefix IS NOT NULL
                AND seller_zip_code_prefix NOT IN (SELECT zip_code_prefix FROM dim_geography))) t"""))
def c8(ctx):
    geo = W.dim_geography(ctx.src["geolocation"])
    return Q.orphans(ctx.src["customers"], geo, "customer_zip_code_prefix", "zip_code_prefix",
                     dataset="dim_customer", skip_null=True).unionByName(
        Q.orphans(ctx.src["sellers"], geo, "seller_zip_code_prefix", "zip_code_prefix",
                  dataset="dim_seller", skip_null=True))


# --- C9-C12 ------------------------------------------------------------------------------------
@register("c9_row_count_rollcall", sql("""
SELECT 'dim_geography' AS table_name, count(*) AS row_count FROM dim_geography
UNION ALL SELECT 'dim_customer', count(*) FROM src_customers
UNION ALL SELECT 'dim_seller', count(*) FROM src_sellers
UNION ALL SELECT 'dim_product', count(*) FROM src_products
UNION ALL SELECT 'dim_date', (SELECT count(*) FROM (SELECT unnest(generate_series(CAST(min(purchase_ts) AS DATE),
                              CAST(max(estimated_ts) AS DATE), INTERVAL 1 DAY)) FROM src_orders) d)
UNION ALL SELECT 'fact_sales', count(*) FROM fact"""))
def c9(ctx):
    geo = W.dim_geography(ctx.src["geolocation"])
    return Q.row_count_rollcall({
        "dim_geography": geo, "dim_customer": W.dim_customer(ctx.src["customers"], geo),
        "dim_seller": W.dim_seller(ctx.src["sellers"], geo),
        "dim_product": W.dim_product(ctx.src["products"], ctx.src["categories"]),
        "dim_date": W.dim_date(ctx.src["orders"]), "fact_sales": ctx.fact})


@register("c10_duplicate_business_keys", sql("""
SELECT 'dim_customer' AS table_name, customer_id AS key_value, count(*) AS cnt FROM src_customers
  GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'dim_seller', seller_id, count(*) FROM src_sellers GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'dim_product', product_id, count(*) FROM src_products GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'fact_sales', order_id || '|' || CAST(order_item_id AS VARCHAR), count(*) FROM fact
  GROUP BY 2 HAVING count(*) > 1"""))
def c10(ctx):
    def dup(df, name, key):
        return (Q.duplicated_groups(df.select(key.alias("key_value")), ["key_value"])
                .select(F.lit(name).alias("table_name"), "key_value", F.col("cnt").cast("long").alias("cnt")))
    return (dup(ctx.src["customers"], "dim_customer", F.col("customer_id"))
            .unionByName(dup(ctx.src["sellers"], "dim_seller", F.col("seller_id")))
            .unionByName(dup(ctx.src["products"], "dim_product", F.col("product_id")))
            .unionByName(dup(ctx.fact, "fact_sales",
                             F.concat_ws("|", F.col("order_id"), F.col("order_item_id").cast("string")))))


@register("c11_warehouse_totals", sql("""
SELECT count(*) AS total_rows, count(DISTINCT order_id) AS distinct_orders,
       CAST(sum(price) AS DOUBLE) AS total_price, CAST(sum(freight_value) AS DOUBLE) AS total_freight,
       CAST(sum(total_sales_amount) AS DOUBLE) AS total_sales,
       CAST(sum(price) AS DOUBLE) / count(price) AS avg_price,
       CAST(sum(freight_value) AS DOUBLE) / count(freight_value) AS avg_freight,
       CAST(sum(total_sales_amount) AS DOUBLE) / count(total_sales_amount) AS avg_sales
FROM fact"""))
def c11(ctx):
    return Q.warehouse_totals(ctx.fact)


@register("c12_warehouse_kpis", sql("""
SELECT count(*) AS total_rows, count(DISTINCT order_id) AS distinct_orders,
       count(DISTINCT customer_unique_id) AS distinct_customers, count(DISTINCT seller_id) AS distinct_sellers,
       count(DISTINCT product_id) AS distinct_products, CAST(sum(total_sales_amount) AS DOUBLE) AS total_sales,
       CASE WHEN count(DISTINCT order_id) > 0
            THEN CAST(sum(total_sales_amount) AS DOUBLE) / count(DISTINCT order_id) ELSE 0 END AS average_order_value
FROM fact"""))
def c12(ctx):
    return Q.warehouse_kpis(ctx.fact)


# --- C13-C15 --------------------------------------------------------------------------------------
def _audit_sql(table_sql: str, name: str, key: str, rev: str, orders: str | None) -> str:
    ord_t = f", sum({orders}) AS orders" if orders else ""
    ord_f = ", count(DISTINCT order_id) AS fact_orders" if orders else ""
    extra = (f"""UNION ALL SELECT '{name}', 'orders_match_fact', CAST(abs(orders - fact_orders) AS DOUBLE),
                 CASE WHEN orders <> fact_orders THEN 'FAIL' ELSE 'PASS' END FROM j""" if orders else "")
    return f"""
, j AS (SELECT * FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE {key} IS NULL) AS null_keys,
                              count(*) - count(DISTINCT {key}) AS dup_keys, CAST(sum({rev}) AS DOUBLE) AS rev,
                              count(*) FILTER (WHERE {rev} < 0) AS neg_rev{ord_t} FROM {table_sql} t) a,
                      (SELECT CAST(sum(total_sales_amount) AS DOUBLE) AS fact_rev{ord_f} FROM fact) b)
SELECT '{name}' AS table_name, 'not_empty' AS check, CAST(CASE WHEN rows = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value,
       CASE WHEN rows = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM j
UNION ALL SELECT '{name}', 'null_key', CAST(null_keys AS DOUBLE), CASE WHEN null_keys > 0 THEN 'FAIL' ELSE 'PASS' END FROM j
UNION ALL SELECT '{name}', 'duplicate_key', CAST(dup_keys AS DOUBLE), CASE WHEN dup_keys > 0 THEN 'FAIL' ELSE 'PASS' END FROM j
UNION ALL SELECT '{name}', 'revenue_matches_fact', abs(rev - fact_rev),
          CASE WHEN abs(rev - fact_rev) > 0.1 THEN 'FAIL' ELSE 'PASS' END FROM j
UNION ALL SELECT '{name}', 'no_negative_revenue', CAST(neg_rev AS DOUBLE), CASE WHEN neg_rev > 0 THEN 'FAIL' ELSE 'PASS' END FROM j
{extra}"""


E1_SQL = """(SELECT month_year AS order_month, sum(total_sales_amount) AS total_revenue,
                    count(DISTINCT order_id) AS total_orders FROM fact GROUP BY 1)"""
E4_SQL = """(SELECT state_code, sum(total_sales_amount) AS total_revenue FROM enriched
             WHERE state_code IS NOT NULL GROUP BY 1)"""


@register("c13_reporting_audit_sales", lambda p: _c13_sql(p, E1_SQL, "reporting_sales_summary",
                                                          "order_month", "total_revenue", "total_orders"))
def c13(ctx):
    return Q.reporting_audit(R.sales_summary(ctx.fact), "reporting_sales_summary", "order_month",
                             "total_revenue", ctx.fact, orders_col="total_orders")


@register("c13_reporting_audit_state", lambda p: _c13_sql(p, E4_SQL, "reporting_state_summary", "state_code",
                                                          "total_revenue", None))
def c13s(ctx):
    return Q.reporting_audit(R.state_summary(ctx.enriched), "reporting_state_summary", "state_code",
                             "total_revenue", ctx.fact)


E2_SQL = """(SELECT COALESCE(product_category_name_english, 'Uncategorized') AS product_category,
                    sum(total_sales_amount) AS total_revenue FROM enriched GROUP BY 1)"""
E6_SQL = """(SELECT customer_unique_id, sum(total_sales_amount) AS lifetime_revenue, count(DISTINCT order_id) AS total_orders
             FROM enriched WHERE customer_unique_id IS NOT NULL GROUP BY 1)"""


@register("c13_reporting_audit_category", lambda p: _c13_sql(p, E2_SQL, "reporting_category_summary", "product_category",
                                                             "total_revenue", None))
def c13c(ctx):
    """Orders of several categories count in each, so that their sum says nothing."""
    return Q.reporting_audit(R.category_summary(ctx.enriched), "reporting_category_summary", "product_category",
                             "total_revenue", ctx.fact)


@register("c13_reporting_audit_customer", lambda p: _c13_sql(p, E6_SQL, "reporting_customer_summary", "customer_unique_id",
                                                             "lifetime_revenue", "total_orders"))
def c13u(ctx):
    return Q.reporting_audit(R.customer_summary(ctx.enriched), "reporting_customer_summary", "customer_unique_id",
                             "lifetime_revenue", ctx.fact, orders_col="total_orders")


def _c13_sql(p, table_sql, name, key, rev, orders):
    from .oracle import base_ctes
    body = _audit_sql(table_sql, name, key, rev, orders)
    first, rest = body.split("\nSELECT", 1)
    return f"WITH {base_ctes(p)}{first}\nSELECT{rest}"


@register("c14_orphan_drilldown", sql("""
SELECT DISTINCT customer_zip_code_prefix, customer_city, customer_state FROM src_customers
WHERE customer_zip_code_prefix NOT IN (SELECT zip_code_prefix FROM dim_geography)"""))
def c14(ctx):
    geo = W.dim_geography(ctx.src["geolocation"])
    return Q.orphan_drilldown(ctx.src["customers"], geo, "customer_zip_code_prefix", "zip_code_prefix",
                              ["customer_zip_code_prefix", "customer_city", "customer_state"])


@register("c15_match_rate", sql("""
SELECT count(*) AS processed, count(*) AS loaded,
       count(*) FILTER (WHERE g.zip_code_prefix IS NOT NULL) AS matched,
       count(*) - count(*) FILTER (WHERE g.zip_code_prefix IS NOT NULL) AS missing,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE g.zip_code_prefix IS NOT NULL) * 100.0 / count(*)
            ELSE 0.0 END AS success_pct
FROM src_customers c LEFT JOIN dim_geography g ON c.zip = g.zip_code_prefix"""))
def c15(ctx):
    geo = W.dim_geography(ctx.src["geolocation"]).select("zip_code_prefix", F.lit(True).alias("_hit"))
    cust = ctx.src["customers"].join(geo, F.col("customer_zip_code_prefix") == F.col("zip_code_prefix"), "left")
    return Q.match_rate(cust, F.col("_hit").isNotNull(), W.dim_customer(ctx.src["customers"],
                                                                      W.dim_geography(ctx.src["geolocation"])))


# --- D1-D11 ---------------------------------------------------------------------------------------------
SOURCE_NAMES = ["customers", "orders", "order_items", "products", "sellers", "payments", "reviews",
                "geolocation", "categories"]


def _profile_sql(name: str) -> str:
    from ..sources.schemas import SOURCES
    cols = [f.name for f in SOURCES[name].fields]
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    src = source_sql(name)
    return f"""SELECT '{name}' AS dataset, count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns,
       CAST({nulls} AS BIGINT) AS missing_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src} x) d) AS duplicate_rows
FROM {src} t"""


@register("d1_dataset_profile", sql(_profile_sql("orders")))
def d1(ctx):
    return P.dataset_profile(ctx.src["orders"], "orders")


@register("d2_column_profile", sql(" UNION ALL ".join(
    f"""SELECT 'order_items' AS dataset, '{c}' AS column_name, '{t}' AS dtype,
        count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, count(*) AS rows
        FROM {source_sql('order_items')} t"""
    for c, t in [("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"),
                 ("seller_id", "string"), ("shipping_limit_date", "string"), ("price", "decimal(12,2)"),
                 ("freight_value", "decimal(14,4)")])))
def d2(ctx):
    return P.column_profile(ctx.src["order_items"], "order_items")


def _profiles_sql() -> str:
    from ..sources.schemas import SOURCES
    parts = []
    for name, schema in SOURCES.items():
        for f in schema.fields:
            c, src = f.name, source_sql(name)
            parts.append(f"""
SELECT '{name}' AS dataset, '{c}' AS column_name, '{f.dataType.simpleString()}' AS dtype,
       count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, count(*) AS rows,
       (SELECT string_agg(v, ' | ' ORDER BY r) FROM (
          SELECT v, row_number() OVER (ORDER BY md5(v), v) AS r
          FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {src} y WHERE {c} IS NOT NULL) z) w WHERE r <= {P.SAMPLES})
         AS sample_values
FROM {src} t""")
    return " UNION ALL ".join(parts)


@register("d2_column_profiles_with_samples", sql(_profiles_sql()))
def d2_all(ctx):
    """Every column of all nine sources, with three values each."""
    from functools import reduce
    from ..sources.schemas import SOURCES
    return reduce(lambda a, b: a.unionByName(b), [P.column_profile(ctx.src[n], n, P.SAMPLES) for n in SOURCES]) \
        .drop("min_value", "max_value")


@register("d3_all_dataset_summary", sql(" UNION ALL ".join(_profile_sql(n) for n in SOURCE_NAMES)))
def d3(ctx):
    return P.all_dataset_summary({n: ctx.src[n] for n in SOURCE_NAMES})


def _missing_sql(name: str) -> str:
    from ..sources.schemas import SOURCES
    src = source_sql(name)
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, '{f.name}' AS column_name,
            count(*) FILTER (WHERE {f.name} IS NULL) AS null_count,
            CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE {f.name} IS NULL) AS DOUBLE) * 100.0
                 / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS missing_pct FROM {src} t"""
        for f in SOURCES[name].fields)


@register("d4_missing_pct", sql(" UNION ALL ".join(_missing_sql(n) for n in SOURCE_NAMES)))
def d4(ctx):
    return P.missing_pct({n: ctx.src[n] for n in SOURCE_NAMES})


@register("d5_duplicate_keys", sql("""
SELECT order_id, order_item_id, count(*) AS cnt FROM src_items GROUP BY 1, 2 HAVING count(*) > 1"""))
def d5(ctx):
    return (Q.duplicated_groups(ctx.src["order_items"], ["order_id", "order_item_id"])
            .withColumn("cnt", F.col("cnt").cast("long")))


RELATIONS = [("order_items", "orders", "order_id"), ("order_items", "products", "product_id"),
             ("order_items", "sellers", "seller_id"), ("orders", "customers", "customer_id"),
             ("payments", "orders", "order_id"), ("reviews", "orders", "order_id")]


@register("d6_relationship_check", sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS child, '{p}' AS parent, '{k}' AS key,
        (SELECT count(*) FROM {source_sql(c)} x WHERE {k} NOT IN (SELECT {k} FROM {source_sql(p)} y)) AS orphans"""
    for c, p, k in RELATIONS)))
def d6(ctx):
    from functools import reduce
    parts = [Q.orphans(ctx.src[c], ctx.src[p], k).select(F.lit(c).alias("child"), F.lit(p).alias("parent"),
                                                          F.lit(k).alias("key"), F.col("violations").alias("orphans"))
             for c, p, k in RELATIONS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("d7_value_distribution", sql("""
SELECT 'order_status' AS attribute, order_status AS value, count(*) AS count FROM src_orders GROUP BY 2
UNION ALL SELECT 'product_category_name', product_category_name, count(*) FROM src_products GROUP BY 2
UNION ALL SELECT 'payment_type', payment_type, count(*) FROM src_payments GROUP BY 2"""))
def d7(ctx):
    return (P.value_distribution(ctx.src["orders"], "order_status")
            .unionByName(P.value_distribution(ctx.src["products"], "product_category_name"))
            .unionByName(P.value_distribution(ctx.src["payments"], "payment_type")))


@register("d8_numeric_summary", sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
        CAST(sum({c}) AS DOUBLE) / count({c}) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std,
        CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25,
        quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75,
        CAST(max({c}) AS DOUBLE) AS max FROM src_items"""
    for c in ("price", "freight_value"))))
def d8(ctx):
    return P.numeric_summary(ctx.src["order_items"], ["price", "freight_value"]) \
            .withColumn("std", F.round("std", 4))


@register("d9_date_range", sql("""
SELECT min(order_purchase_timestamp) AS min_date, max(order_purchase_timestamp) AS max_date FROM src_orders"""))
def d9(ctx):
    return P.date_range(ctx.src["orders"], "order_purchase_timestamp")


@register("d10_cardinality_ratio", sql("""
SELECT c.distinct_customers, o.distinct_orders,
       CASE WHEN c.distinct_customers > 0 THEN CAST(o.distinct_orders AS DOUBLE) / CAST(c.distinct_customers AS DOUBLE)
       END AS orders_per_customer
FROM (SELECT count(DISTINCT customer_unique_id) AS distinct_customers FROM src_customers) c,
     (SELECT count(DISTINCT order_id) AS distinct_orders FROM src_orders) o"""))
def d10(ctx):
    return P.cardinality_ratio(ctx.src["customers"], ctx.src["orders"])


@register("d11_domain_rules", sql("""
SELECT i.a AS price_non_negative, i.b AS freight_non_negative, r.c AS score_in_range, p.d AS payment_positive,
       i.a AND i.b AND r.c AND p.d AS all_pass
FROM (SELECT COALESCE(bool_and(price >= 0), TRUE) AS a, COALESCE(bool_and(freight_value >= 0), TRUE) AS b
      FROM src_items) i,
     (SELECT COALESCE(bool_and(review_score BETWEEN 1 AND 5), TRUE) AS c FROM src_reviews) r,
     (SELECT COALESCE(bool_and(payment_value > 0), TRUE) AS d FROM src_payments) p"""))
def d11(ctx):
    return P.domain_rules(ctx.src["order_items"], ctx.src["reviews"], ctx.src["payments"])


# --- C1, and C1-C8 as the load run applies them ------------------------------------------------------
_CHECKED = ["customers", "orders", "order_items", "products", "sellers"]


@register("c1_schema_check", lambda p: "SELECT * FROM (VALUES " + ", ".join(
    [f"('schema', '{n}', '', CAST(0 AS BIGINT), 'PASS')" for n in _CHECKED if n != "sellers"]
    + ["('schema', 'sellers', 'seller_city', CAST(1 AS BIGINT), 'FAIL')"]) + ") t(\"check\", dataset, key, violations, status)")
def c1(ctx):
    """Five sources, one of them without a column that it must have."""
    from ..sources.schemas import REQUIRED
    frames = {n: ctx.src[n] for n in _CHECKED}
    frames["sellers"] = frames["sellers"].drop("seller_city")
    return Q.schema_check(ctx.spark, frames, {n: REQUIRED[n] for n in _CHECKED})


def _load_findings_sql(p) -> str:
    from .warehouse_load import STAGES
    from .oracle import with_base
    counted = {
        ("dim_customer", "null_geography_key"): "SELECT count(*) FROM src_customers WHERE zip IS NULL OR zip NOT IN (SELECT zip_code_prefix FROM dim_geography)",
        ("dim_seller", "null_geography_key"): "SELECT count(*) FROM src_sellers WHERE seller_zip_code_prefix IS NULL OR seller_zip_code_prefix NOT IN (SELECT zip_code_prefix FROM dim_geography)",
        ("dim_product", "null_product_category_name_english"): "SELECT count(*) FROM dim_product WHERE product_category_name_english IS NULL",
    }
    rows = []
    for s in STAGES:
        for kind, level, rules in (("rule", "FAIL", s.must), ("null_keys", "WARN", s.warn)):
            for key in rules:
                n = counted.get((s.table, key), "SELECT 0")
                rows.append(f"SELECT '{kind}' AS check, '{s.table}' AS dataset, '{key}' AS key, CAST(({n}) AS BIGINT) AS violations, "
                            f"CASE WHEN ({n}) > 0 THEN '{level}' ELSE 'PASS' END AS status")
        n = ("SELECT COALESCE(sum(c), 0) FROM (SELECT count(*) AS c FROM src_items JOIN src_orders USING (order_id) "
             "GROUP BY order_id, order_item_id HAVING count(*) > 1) d" if s.name == "fact" else "SELECT 0")
        rows.append(f"SELECT 'grain', '{s.table}', '{','.join(s.unique)}', CAST(({n}) AS BIGINT), "
                    f"CASE WHEN ({n}) > 0 THEN '{s.repeats}' ELSE 'PASS' END")
        rows += [f"SELECT 'row_count', '{s.table}', 'more_than_source', CAST(0 AS BIGINT), 'PASS'"] if s.totals else []
        rows += [f"SELECT 'reconciliation', '{s.table}', '{t}', CAST(0 AS BIGINT), 'PASS'" for t in s.totals]
    return with_base(" UNION ALL ".join(rows), p)


@register("c1_c8_load_findings", _load_findings_sql)
def load_findings(ctx):
    from .warehouse_load import load_findings as run
    return run(ctx, ctx.scratch("c1_c8_load"))
