"""Adapter from the driver's TPC-H-like Parquet tables to the nine sources.

Every column is a plain projection of one driver table (plus the tiny
nation/region dimensions), so the adapter adds no shuffle of its own and
Catalyst pushes column pruning and filters through it to the Parquet
scans.  ``plans/oracle.py`` spells out the same mapping in SQL.

Mapping (FIXTURES.md section 3):
  order_items  <- lineitem       orders     <- orders
  customers    <- customer       sellers    <- supplier
  products     <- part           payments   <- lineitem (one per line)
  reviews      <- lineitem       geolocation<- customer (nation 24 left out
                                               so that orphan branches run)
  categories   <- fixed map below (PROMO left out: NULL English name)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Category translation used for the fixture
# (source name -> English name; PROMO deliberately missing).
CATEGORY_MAP = [
    ("ECONOMY", "economy"),
    ("LARGE", "large"),
    ("MEDIUM", "medium"),
    ("SMALL", "small"),
    ("STANDARD", "standard"),
]

# Order status and payment type names for the fixture.
ORDER_STATUS = {"F": "delivered", "O": "shipped", "P": "processing"}
PAYMENT_TYPE = {"A": "credit_card", "N": "boleto", "R": "voucher"}

# geolocation has no rows for this nation (orphan coverage)
MISSING_GEO_NATION = 24

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def state_code(nationkey: Column) -> Column:
    """Two-letter state code of a nation: 'S' + letter (0 -> 'SA')."""
    return F.concat(F.lit("S"), F.chr(nationkey + F.lit(65)))


def _map(col: Column, mapping: dict, default: str) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(default)


def _ts_string(col: Column) -> Column:
    return F.date_format(col, TS_FMT)


def _places(spark, sf_dir) -> DataFrame:
    """nation -> (zip, city, state) for customers, sellers and geolocation."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_nationkey").alias("nk"),
                     F.lower("r_name").alias("city"),
                     state_code(F.col("n_nationkey")).alias("state")))


def load_fixture_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine source frames, lazily, from the driver tables."""
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders")
    cu = read_table(spark, sf_dir, "customer")
    su = read_table(spark, sf_dir, "supplier")
    pa = read_table(spark, sf_dir, "part")
    places = _places(spark, sf_dir)

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    order_items = li.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        _ts_string(F.col("l_shipdate")).alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(14,4)").alias("freight_value"),
    )

    purchase = F.col("o_orderdate")
    orders = od.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _map(F.col("o_orderstatus"), ORDER_STATUS, "unavailable").alias("order_status"),
        _ts_string(purchase).alias("order_purchase_timestamp"),
        _ts_string(purchase).alias("order_approved_at"),
        F.when(F.col("o_orderstatus") == "F", _ts_string(purchase + F.expr("INTERVAL 3 DAYS")))
         .alias("order_delivered_carrier_date"),
        F.when(F.col("o_orderstatus") == "F", _ts_string(purchase + F.expr("INTERVAL 10 DAYS")))
         .alias("order_delivered_customer_date"),
        _ts_string(purchase + F.expr("INTERVAL 21 DAYS")).alias("order_estimated_delivery_date"),
    )

    customers = (cu.join(places, cu.c_nationkey == places.nk, "left")
                 .select(F.col("c_custkey").cast("string").alias("customer_id"),
                         F.col("c_custkey").cast("string").alias("customer_unique_id"),
                         F.col("c_nationkey").alias("customer_zip_code_prefix"),
                         F.col("city").alias("customer_city"),
                         F.col("state").alias("customer_state")))

    sellers = (su.join(places, su.s_nationkey == places.nk, "left")
               .select(F.col("s_suppkey").cast("string").alias("seller_id"),
                       F.col("s_nationkey").alias("seller_zip_code_prefix"),
                       F.col("city").alias("seller_city"),
                       F.col("state").alias("seller_state")))

    products = pa.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        (F.length("p_brand") * 10).alias("product_description_lenght"),
        (F.col("p_size") % 4 + 1).alias("product_photos_qty"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        F.col("p_size").alias("product_length_cm"),
        (F.col("p_size") % 7 + 1).alias("product_height_cm"),
        (F.col("p_size") % 5 + 1).alias("product_width_cm"),
    )

    payments = li.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        _map(F.col("l_returnflag"), PAYMENT_TYPE, "not_defined").alias("payment_type"),
        F.col("l_quantity").cast("int").alias("payment_installments"),
        price.alias("payment_value"),
    )

    reviews = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
         .alias("review_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        (F.col("l_linenumber") % 5 + 1).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("status "), F.col("l_linestatus")))
         .alias("review_comment_message"),
        _ts_string(F.col("l_shipdate")).alias("review_creation_date"),
        _ts_string(F.col("l_shipdate")).alias("review_answer_timestamp"),
    )

    geolocation = (cu.where(F.col("c_nationkey") != MISSING_GEO_NATION)
                   .join(places, cu.c_nationkey == places.nk, "left")
                   .select(F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
                           (F.lit(-20.0) + F.col("c_acctbal") / 1000.0).alias("geolocation_lat"),
                           (F.lit(-45.0) - F.col("c_acctbal") / 2000.0).alias("geolocation_lng"),
                           F.col("city").alias("geolocation_city"),
                           F.col("state").alias("geolocation_state")))

    categories = spark.createDataFrame(
        CATEGORY_MAP, "product_category_name string, product_category_name_english string")

    return {
        "customers": customers, "orders": orders, "order_items": order_items,
        "products": products, "sellers": sellers, "payments": payments,
        "reviews": reviews, "geolocation": geolocation, "categories": categories,
    }
