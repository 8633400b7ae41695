"""Star-schema builds as DataFrame plans.

Two flavours of the fact are built from the same pieces:

* ``fact_sales`` (B9-B11) with surrogate keys looked up from keyed,
  materialised dimensions -- the stored warehouse;
* ``denormalized_fact`` (B13) joined on natural keys, which needs no
  key lookup at all and is what every reporting / dashboard / ML job
  reads.  Both give the same rows.

Join strategy: what belongs to an order is joined to the orders, so that
items are shuffled on product and order, and on seller only if the
sellers are too many to broadcast; rows without a key are spread
(``looked_up``).  No explicit hints; all joins are left to the planner: with AQE on, a side whose measured
shuffle output is under ``spark.sql.autoBroadcastJoinThreshold`` is
turned into a broadcast at run time, everything else stays a
sort-merge join, and AQE splits skewed partitions of the big side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.dates import calendar_columns, date_key, month_year, parse_ts
from ..functions.keys import with_dense_key, with_unique_key

MONEY = "decimal(12,2)"


# --- B1 ----------------------------------------------------------------------
def dim_geography(geolocation: DataFrame) -> DataFrame:
    """One row per zip prefix: first city/state, mean lat/lng.

    "First" is made deterministic: the (city, state) pair that sorts
    first within the zip (CSV row order does not survive a distributed
    read).  Partial aggregation runs before the shuffle.
    """
    g = geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"),
        F.col("geolocation_city").alias("city_name"),
        F.col("geolocation_state").alias("state_code"),
        F.col("geolocation_lat").alias("latitude"),
        F.col("geolocation_lng").alias("longitude"))
    first = F.min(F.struct("city_name", "state_code"))
    return (g.groupBy("zip_code_prefix")
             .agg(first.alias("_first"), F.avg("latitude").alias("latitude"),
                  F.avg("longitude").alias("longitude"))
             .select("zip_code_prefix", F.col("_first.city_name").alias("city_name"),
                     F.col("_first.state_code").alias("state_code"), "latitude", "longitude"))


# --- B2 / B3 ---------------------------------------------------------------------
def dim_customer(customers: DataFrame, geo: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """customers left join geography on zip; geography columns travel along
    so that the denormalised fact needs no second geography join.  ``keep``: further customer columns."""
    return (customers.join(geo, customers.customer_zip_code_prefix == geo.zip_code_prefix, "left")
            .select("customer_id", "customer_unique_id", *keep, *(
                [F.col("geography_key")] if "geography_key" in geo.columns else []),
                F.col("city_name").alias("customer_city_name"),
                F.col("state_code").alias("customer_state_code")))


def dim_seller(sellers: DataFrame, geo: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return (sellers.join(geo, sellers.seller_zip_code_prefix == geo.zip_code_prefix, "left")
            .select("seller_id", *keep, *([F.col("geography_key")] if "geography_key" in geo.columns else []),
                    F.col("city_name").alias("seller_city_name"),
                    F.col("state_code").alias("seller_state_code")))


# --- B4 ------------------------------------------------------------------------------
def dim_product(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Category translation (a ~70-row table), volume, renamed sizes."""
    return (products.join(categories, "product_category_name", "left")
            .select("product_id", "product_category_name", "product_category_name_english",
                    F.col("product_name_lenght").alias("product_name_length"),
                    F.col("product_description_lenght").alias("product_description_length"),
                    "product_photos_qty", "product_weight_g", "product_length_cm",
                    "product_height_cm", "product_width_cm",
                    (F.col("product_length_cm") * F.col("product_height_cm")
                     * F.col("product_width_cm")).alias("product_volume_cm3")))


# --- B5 ------------------------------------------------------------------------------
def dim_date(orders: DataFrame) -> DataFrame:
    """Calendar from the first purchase day to the last *estimated* delivery day.

    The bounds are one global aggregate (partial per task); the calendar
    itself is a few thousand rows whatever the table size.
    """
    bounds = orders.agg(
        F.min(F.to_date(parse_ts("order_purchase_timestamp"))).alias("lo"),
        F.max(F.to_date(parse_ts("order_estimated_delivery_date"))).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    return days.select("full_date", *calendar_columns(F.col("full_date")))


# --- B7 / B8 -------------------------------------------------------------------------
def aggregate_payments(payments: DataFrame) -> DataFrame:
    """Per order: total, max installments, type of the first payment, count.

    "First" = lowest payment_sequential; ties broken by the remaining
    columns so the choice is deterministic.
    """
    order_key = F.struct("payment_sequential", "payment_type", "payment_installments", "payment_value")
    return (payments.groupBy("order_id")
            .agg(F.round(F.sum("payment_value"), 2).alias("payment_total"),
                 F.max("payment_installments").alias("payment_installments_max"),
                 F.min_by("payment_type", order_key).alias("primary_payment_type"),
                 F.count("payment_sequential").alias("payment_count")))


def aggregate_reviews(reviews: DataFrame) -> DataFrame:
    return (reviews.groupBy("order_id")
            .agg(F.round(F.avg("review_score"), 2).alias("review_score_avg"),
                 F.count("review_comment_message").alias("review_comment_count")))


# --- B10 / B12 -----------------------------------------------------------------------
def cents(items: DataFrame) -> DataFrame:
    """Money rounded to cents as DECIMAL (exact sums later)."""
    return items.withColumns({c: F.round(F.col(c), 2).cast(MONEY) for c in ("price", "freight_value")})


def totals(items: DataFrame) -> DataFrame:
    """quantity = 1 and the item total, of items in ``cents``."""
    return (items.withColumn("quantity", F.lit(1))
                 .withColumn("total_sales_amount", (F.col("price") + F.col("freight_value"))
                             .cast("decimal(13,2)")))


def measures(items: DataFrame) -> DataFrame:
    """All measures of an item: ``cents`` and ``totals``."""
    return totals(cents(items))


def shipping_ratio(fact: DataFrame, digits: int | None = 4) -> DataFrame:
    """Freight share of the item total (rounded to ``digits``); NULL when the total is 0."""
    total = F.col("price") + F.col("freight_value")
    r = F.when(total == 0, F.lit(None).cast("double")) \
         .otherwise(F.col("freight_value").cast("double") / total.cast("double"))
    return fact.withColumn("shipping_ratio", r if digits is None else F.round(r, digits))


# --- B15 -----------------------------------------------------------------------------
def rule_segments(items_orders: DataFrame, params: Params) -> DataFrame:
    """customer_unique_id -> new / repeat / vip.

    Two-level aggregate (customer, order) -> customer so the distinct
    order count is a plain count and both levels combine map-side; a
    customer holding a third of all rows is still one partial
    aggregate per task.
    """
    per_order = (items_orders.groupBy("customer_unique_id", "order_id")
                 .agg(F.sum("total_sales_amount").alias("revenue")))
    return order_segments(per_order, params)


def order_segments(orders: DataFrame, params: Params) -> DataFrame:
    """The same from a row per order (customer_unique_id, revenue)."""
    per_cust = (orders.groupBy("customer_unique_id")
                .agg(F.sum("revenue").alias("lifetime_revenue"), F.count(F.lit(1)).alias("order_count")))
    seg = (F.when(F.col("lifetime_revenue") >= F.lit(params.vip_min), "vip")
            .when(F.col("order_count") > 1, "repeat").otherwise("new"))
    return per_cust.select("customer_unique_id", seg.alias("segment"))


# --- B11 / B13 -----------------------------------------------------------------------
def looked_up(rows: DataFrame, dim: DataFrame, key: str, spread: str = "order_id") -> DataFrame:
    """Left join on ``key``; rows without a key are spread over the tasks by another column.

    NULL keys never match, yet a shuffle would send all of them to one
    task; they get a stand-in that no dimension row has.
    """
    stand_in = F.when(F.col(key).isNull(), F.xxhash64(spread))
    return (rows.withColumn("_spread", stand_in)
            .join(dim.withColumnRenamed(key, "_key").withColumn("_spread_key", F.lit(None).cast("long")),
                  F.col(key).eqNullSafe(F.col("_key")) & F.col("_spread").eqNullSafe(F.col("_spread_key")), "left")
            .drop("_spread", "_spread_key", "_key"))


def items_with_orders(src: dict[str, DataFrame]) -> DataFrame:
    """order_items inner join orders (both shuffled on order_id)."""
    o = src["orders"].select("order_id", "customer_id", "order_purchase_timestamp")
    return measures(src["order_items"]).join(o, "order_id", "inner")


def order_attributes(src: dict[str, DataFrame], params: Params) -> DataFrame:
    """A row per order: customer, segment, place and purchase day.

    Everything that an item takes from its order is joined at the
    order's grain.  Items come in as revenue per order, added up before
    the shuffle.  Of the purchase time only the day is shuffled; what
    follows from it is computed by ``purchase_columns``.
    """
    geo = dim_geography(src["geolocation"])
    cust = dim_customer(src["customers"], geo)
    day = F.to_date(parse_ts("order_purchase_timestamp")).alias("order_date")
    orders = looked_up(src["orders"].select("order_id", "customer_id", day), cust, "customer_id")
    revenue = measures(src["order_items"]).groupBy("order_id").agg(F.sum("total_sales_amount").alias("revenue"))
    sold = orders.where(F.col("customer_unique_id").isNotNull()).select("order_id", "customer_unique_id").join(revenue, "order_id")
    segs = order_segments(sold, params)
    return looked_up(orders, segs, "customer_unique_id").select(
        "order_id", "customer_id", "customer_unique_id", "segment", F.col("customer_state_code").alias("state_code"),
        F.col("customer_city_name").alias("customer_city"), "order_date")


def purchase_columns(day: str = "order_date") -> dict[str, Column]:
    """What the fact has of a purchase day."""
    return {"purchase_date_key": date_key(F.col(day)), "month_year": month_year(F.col(day)),
            "year_number": F.year(day), "month_number": F.month(day)}


def enriched_fact(src: dict[str, DataFrame], params: Params, store=None) -> DataFrame:
    """Item-grain fact joined to every dimension on natural keys.

    Dimension attributes stay NULL where the dimension row is missing
    (the SQL views' LEFT JOIN semantics); ``denormalized_fact`` adds the
    'unknown' defaults on top.  Item rows are shuffled on product and on
    order, and carry neither what is computed from them nor seller
    places; sellers come last.  ``store(df, name)`` writes a table:
    Spark knows the size of the written sellers before it plans the
    join, broadcasts them if they are small, and else shuffles the items
    once more.
    """
    geo = dim_geography(src["geolocation"])
    sell = dim_seller(src["sellers"], geo).withColumn("_seller_found", F.lit(True))
    if store:
        sell = store(sell, "seller_places")
    prod = dim_product(src["products"], src["categories"]).select("product_id", "product_category_name_english")
    items = looked_up(cents(src["order_items"]), prod, "product_id").join(order_attributes(src, params), "order_id")
    return (totals(looked_up(items, sell, "seller_id")).withColumns(purchase_columns())
            .select(
                "order_id", "order_item_id", "customer_id", "product_id",
                F.when(F.col("_seller_found"), F.col("seller_id")).alias("seller_id"),
                "order_date", "purchase_date_key",
                "quantity", "price", "freight_value", "total_sales_amount",
                "customer_unique_id", "segment", "state_code", "customer_city",
                "product_category_name_english",
                F.col("seller_city_name").alias("seller_city"),
                F.col("seller_state_code").alias("seller_state"),
                "month_year", "year_number", "month_number"))


UNKNOWN_DEFAULTED = ["customer_unique_id", "segment", "state_code", "customer_city",
                     "product_category_name_english", "seller_id", "seller_city", "seller_state"]


def denormalize(enriched: DataFrame) -> DataFrame:
    """COALESCE(attribute, 'unknown') over the enriched fact (a projection)."""
    return enriched.select(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) if c in UNKNOWN_DEFAULTED
                             else F.col(c) for c in enriched.columns])


def denormalized_fact(src: dict[str, DataFrame], params: Params) -> DataFrame:
    return denormalize(enriched_fact(src, params))


# --- keyed warehouse (B6, B9, B11, B14) -----------------------------------------------
def keyed_geography(geolocation: DataFrame) -> DataFrame:
    return with_dense_key(dim_geography(geolocation), ["zip_code_prefix"], "geography_key")


def keyed_customer(customers: DataFrame) -> DataFrame:
    """From ``dim_customer`` rows."""
    return with_dense_key(customers.select("customer_id", "customer_unique_id", "geography_key"), ["customer_id"], "customer_key")


def keyed_seller(sellers: DataFrame) -> DataFrame:
    return with_dense_key(sellers.select("seller_id", "geography_key"), ["seller_id"], "seller_key")


def keyed_product(products: DataFrame) -> DataFrame:
    return with_dense_key(products, ["product_id"], "product_key")


def keyed_dimensions(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Dimensions with dense surrogate keys in natural-key order."""
    from concurrent.futures import ThreadPoolExecutor
    geo = keyed_geography(src["geolocation"])
    geo_k = geo.select("geography_key", "zip_code_prefix", "city_name", "state_code")
    jobs = {
        "dim_customer": lambda: keyed_customer(dim_customer(src["customers"], geo_k)),
        "dim_seller": lambda: keyed_seller(dim_seller(src["sellers"], geo_k)),
        "dim_product": lambda: keyed_product(dim_product(src["products"], src["categories"])),
    }
    # the three key assignments are independent Spark jobs: submit them together
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = {k: pool.submit(fn) for k, fn in jobs.items()}
        dims = {k: f.result() for k, f in futures.items()}
    return {"dim_geography": geo, **dims, "dim_date": dim_date(src["orders"])}


def fact_sales(src: dict[str, DataFrame], dims: dict[str, DataFrame]) -> DataFrame:
    """Items x orders, key lookups (B9), measures (B10), audit columns.

    The customer and date keys belong to the order and are looked up at
    its grain; a purchase day that the calendar lacks has no date key.
    The reference also left-joins the per-order payment and review
    aggregates (B7/B8) and then drops every column they bring; a left
    join on a unique key cannot change the item rows, so those two
    shuffles are skipped here.
    """
    day = date_key(F.to_date(parse_ts("order_purchase_timestamp")))
    orders = looked_up(src["orders"].select("order_id", "customer_id", day.alias("_day")),
                       dims["dim_customer"].select("customer_id", "customer_key"), "customer_id")
    orders = looked_up(orders, dims["dim_date"].select(F.col("date_key").alias("_day"),
                                                       F.col("date_key").alias("purchase_date_key")), "_day")
    items = looked_up(measures(src["order_items"]), dims["dim_product"].select("product_id", "product_key"), "product_id")
    items = looked_up(items, dims["dim_seller"].select("seller_id", "seller_key"), "seller_id")
    now = F.current_timestamp()
    return with_unique_key(
        items.join(orders.select("order_id", "customer_key", "purchase_date_key"), "order_id").select(
            "order_id", "order_item_id", "customer_key", "product_key", "seller_key",
            "purchase_date_key", "quantity", "price", "freight_value", "total_sales_amount",
            now.alias("etl_created_at"), now.alias("etl_updated_at")),
        "sales_key")
