"""Fixed schemas of the nine source tables (no inference at the boundary).

Column names are the source system's, misspellings included
(``product_name_lenght``); dim_product renames them.
"""

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DecimalType(12, 2)


def _schema(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


CUSTOMERS = _schema(("customer_id", S), ("customer_unique_id", S),
                    ("customer_zip_code_prefix", I), ("customer_city", S), ("customer_state", S))

ORDERS = _schema(("order_id", S), ("customer_id", S), ("order_status", S),
                 ("order_purchase_timestamp", S), ("order_approved_at", S),
                 ("order_delivered_carrier_date", S), ("order_delivered_customer_date", S),
                 ("order_estimated_delivery_date", S))

ORDER_ITEMS = _schema(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                      ("shipping_limit_date", S), ("price", D), ("freight_value", T.DecimalType(14, 4)))

PRODUCTS = _schema(("product_id", S), ("product_category_name", S),
                   ("product_name_lenght", I), ("product_description_lenght", I),
                   ("product_photos_qty", I), ("product_weight_g", I),
                   ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I))

SELLERS = _schema(("seller_id", S), ("seller_zip_code_prefix", I), ("seller_city", S), ("seller_state", S))

PAYMENTS = _schema(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                   ("payment_installments", I), ("payment_value", D))

REVIEWS = _schema(("review_id", S), ("order_id", S), ("review_score", I),
                  ("review_comment_title", S), ("review_comment_message", S),
                  ("review_creation_date", S), ("review_answer_timestamp", S))

GEOLOCATION = _schema(("geolocation_zip_code_prefix", I), ("geolocation_lat", T.DoubleType()),
                      ("geolocation_lng", T.DoubleType()), ("geolocation_city", S),
                      ("geolocation_state", S))

CATEGORIES = _schema(("product_category_name", S), ("product_category_name_english", S))

SOURCES = {
    "customers": CUSTOMERS, "orders": ORDERS, "order_items": ORDER_ITEMS,
    "products": PRODUCTS, "sellers": SELLERS, "payments": PAYMENTS,
    "reviews": REVIEWS, "geolocation": GEOLOCATION, "categories": CATEGORIES,
}

# required columns per source, for the schema check
REQUIRED = {name: [f.name for f in schema.fields] for name, schema in SOURCES.items()}
