"""The fixture mapping and the shared fact in plain SQL, for the DuckDB oracle.

``with_base(sql)`` prefixes a query with CTEs that rebuild, from the
driver tables, exactly what ``sources/fixture.py`` and
``operators/warehouse.py`` compute:

  enriched  item-grain fact, NULL where a dimension row is missing
  fact      the same with 'unknown' defaults (B13)
  orders_g  order grain (E17)

Money follows the same decimal arithmetic as the Spark side; results are
cast to DOUBLE / BIGINT on both sides.
"""

from __future__ import annotations

from ..config import Params
from ..sources.fixture import CATEGORY_MAP, MISSING_GEO_NATION, ORDER_STATUS, PAYMENT_TYPE


def _case(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{default}' END"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


def base_ctes(params: Params) -> str:
    return f"""
places AS (
  SELECT n.n_nationkey AS nk, lower(r.r_name) AS city, 'S' || chr(65 + n.n_nationkey) AS state
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
src_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipping_limit_date,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(14,4)) AS freight_value
  FROM lineitem),
src_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         {_case('o_orderstatus', ORDER_STATUS, 'unavailable')} AS order_status,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_approved_at,
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') END
           AS order_delivered_carrier_date,
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d %H:%M:%S') END
           AS order_delivered_customer_date,
         strftime(o_orderdate + INTERVAL 21 DAY, '%Y-%m-%d %H:%M:%S') AS order_estimated_delivery_date,
         o_orderdate AS purchase_ts, o_orderdate + INTERVAL 21 DAY AS estimated_ts
  FROM orders),
src_customers AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id, CAST(c.c_custkey AS VARCHAR) AS customer_unique_id,
         c.c_nationkey AS zip, c.c_nationkey AS customer_zip_code_prefix, p.city AS customer_city,
         p.state AS customer_state
  FROM customer c LEFT JOIN places p ON c.c_nationkey = p.nk),
src_sellers AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS seller_id, s.s_nationkey AS seller_zip_code_prefix,
         p.city AS seller_city, p.state AS seller_state
  FROM supplier s LEFT JOIN places p ON s.s_nationkey = p.nk),
src_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS product_category_name,
         CAST(length(p_name) AS INTEGER) AS product_name_lenght,
         CAST(length(p_brand) * 10 AS INTEGER) AS product_description_lenght,
         p_size % 4 + 1 AS product_photos_qty, p_size * 100 AS product_weight_g,
         p_size AS product_length_cm, p_size % 7 + 1 AS product_height_cm, p_size % 5 + 1 AS product_width_cm
  FROM part),
src_geo AS (
  SELECT c.c_nationkey AS zip, -20.0 + c.c_acctbal / 1000.0 AS lat, -45.0 - c.c_acctbal / 2000.0 AS lng,
         p.city, p.state, c.c_nationkey AS geolocation_zip_code_prefix,
         -20.0 + c.c_acctbal / 1000.0 AS geolocation_lat, -45.0 - c.c_acctbal / 2000.0 AS geolocation_lng,
         p.city AS geolocation_city, p.state AS geolocation_state
  FROM customer c LEFT JOIN places p ON c.c_nationkey = p.nk
  WHERE c.c_nationkey <> {MISSING_GEO_NATION}),
src_payments AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS payment_sequential,
         {_case('l_returnflag', PAYMENT_TYPE, 'not_defined')} AS payment_type,
         CAST(l_quantity AS INTEGER) AS payment_installments,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS payment_value
  FROM lineitem),
src_reviews AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber % 5 + 1 AS review_score,
         CAST(NULL AS VARCHAR) AS review_comment_title,
         CASE WHEN l_returnflag <> 'N' THEN 'status ' || l_linestatus END AS review_comment_message,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS review_creation_date,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS review_answer_timestamp
  FROM lineitem),
categories AS (
  SELECT * FROM (VALUES {_values(CATEGORY_MAP)}) t(product_category_name, product_category_name_english)),
dim_geography AS (
  SELECT zip AS zip_code_prefix, min(city) AS city_name, first(state ORDER BY city, state) AS state_code,
         avg(lat) AS latitude, avg(lng) AS longitude
  FROM src_geo GROUP BY zip),
dim_customer AS (
  SELECT c.customer_id, c.customer_unique_id, g.city_name AS customer_city_name,
         g.state_code AS customer_state_code
  FROM src_customers c LEFT JOIN dim_geography g ON c.zip = g.zip_code_prefix),
dim_seller AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS seller_id, g.city_name AS seller_city_name,
         g.state_code AS seller_state_code
  FROM supplier s LEFT JOIN dim_geography g ON s.s_nationkey = g.zip_code_prefix),
dim_product AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS product_id, p.p_type AS product_category_name,
         c.product_category_name_english
  FROM part p LEFT JOIN categories c ON p.p_type = c.product_category_name),
items AS (
  SELECT order_id, order_item_id, product_id, seller_id, 1 AS quantity,
         CAST(round(price, 2) AS DECIMAL(12,2)) AS price,
         CAST(round(freight_value, 2) AS DECIMAL(12,2)) AS freight_value
  FROM src_items),
ioc AS (
  SELECT i.*, CAST(i.price + i.freight_value AS DECIMAL(13,2)) AS total_sales_amount,
         o.customer_id, o.purchase_ts, c.customer_unique_id, c.customer_city_name, c.customer_state_code
  FROM items i JOIN src_orders o ON i.order_id = o.order_id
  LEFT JOIN dim_customer c ON o.customer_id = c.customer_id),
segs AS (
  SELECT customer_unique_id,
         CASE WHEN sum(rev) >= {params.vip_min!r} THEN 'vip' WHEN count(*) > 1 THEN 'repeat' ELSE 'new' END AS segment
  FROM (SELECT customer_unique_id, order_id, sum(total_sales_amount) AS rev
        FROM ioc WHERE customer_unique_id IS NOT NULL GROUP BY 1, 2) t
  GROUP BY customer_unique_id),
enriched AS (
  SELECT x.order_id, x.order_item_id, x.customer_id, x.product_id, s.seller_id,
         CAST(x.purchase_ts AS DATE) AS order_date,
         CAST(strftime(x.purchase_ts, '%Y%m%d') AS INTEGER) AS purchase_date_key,
         x.quantity, x.price, x.freight_value, x.total_sales_amount,
         x.customer_unique_id, g.segment, x.customer_state_code AS state_code,
         x.customer_city_name AS customer_city, p.product_category_name_english,
         s.seller_city_name AS seller_city, s.seller_state_code AS seller_state,
         strftime(x.purchase_ts, '%Y-%m') AS month_year, CAST(year(x.purchase_ts) AS INTEGER) AS year_number,
         CAST(month(x.purchase_ts) AS INTEGER) AS month_number
  FROM ioc x
  LEFT JOIN dim_product p ON x.product_id = p.product_id
  LEFT JOIN dim_seller s ON x.seller_id = s.seller_id
  LEFT JOIN segs g ON x.customer_unique_id = g.customer_unique_id),
fact AS (
  SELECT order_id, order_item_id, customer_id, product_id, order_date, purchase_date_key,
         quantity, price, freight_value, total_sales_amount,
         COALESCE(customer_unique_id, 'unknown') AS customer_unique_id,
         COALESCE(segment, 'unknown') AS segment,
         COALESCE(state_code, 'unknown') AS state_code,
         COALESCE(customer_city, 'unknown') AS customer_city,
         COALESCE(product_category_name_english, 'unknown') AS product_category_name_english,
         COALESCE(seller_id, 'unknown') AS seller_id,
         COALESCE(seller_city, 'unknown') AS seller_city,
         COALESCE(seller_state, 'unknown') AS seller_state,
         month_year, year_number, month_number
  FROM enriched),
orders_g AS (
  SELECT order_id, max(customer_unique_id) AS customer_unique_id, max(segment) AS segment,
         max(state_code) AS state_code, max(month_year) AS month_year,
         sum(total_sales_amount) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity,
         sum(freight_value) AS freight
  FROM fact GROUP BY order_id)"""


def with_base(sql: str, params: Params, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes.strip() else ""
    return f"WITH {base_ctes(params)}{extra}\n{sql}"
