"""Reference unit tests re-expressed (transform / validation literals) plus key tests."""

from decimal import Decimal

from pyspark.sql import functions as F

from emporio.operators import quality as Q
from emporio.operators import warehouse as W
from emporio.functions.keys import with_dense_key


def test_geography_groups_by_zip(spark):
    geo = spark.createDataFrame(
        [(1001, -23.5, -46.6, "sao paulo", "SP"), (1001, -23.6, -46.7, "sao paulo", "SP"),
         (1002, -22.9, -43.1, "rio", "RJ")],
        "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, "
        "geolocation_city string, geolocation_state string")
    out = {r.zip_code_prefix: r for r in W.dim_geography(geo).collect()}
    assert len(out) == 2
    assert out[1001].city_name == "sao paulo" and out[1001].state_code == "SP"
    assert abs(out[1001].latitude - (-23.55)) < 1e-9 and abs(out[1001].longitude - (-46.65)) < 1e-9


def test_product_volume_and_translation(spark):
    prod = spark.createDataFrame(
        [("p1", "perfumaria", 10, 100, 1, 500, 10, 5, 4)],
        "product_id string, product_category_name string, product_name_lenght int, "
        "product_description_lenght int, product_photos_qty int, product_weight_g int, "
        "product_length_cm int, product_height_cm int, product_width_cm int")
    cats = spark.createDataFrame([("perfumaria", "perfumery")],
                                 "product_category_name string, product_category_name_english string")
    r = W.dim_product(prod, cats).first()
    assert r.product_volume_cm3 == 200
    assert r.product_category_name_english == "perfumery"
    assert r.product_name_length == 10


def test_payment_aggregation(spark):
    pay = spark.createDataFrame(
        [("o1", 1, "credit_card", 2, Decimal("50.00")), ("o1", 2, "voucher", 1, Decimal("25.00"))],
        "order_id string, payment_sequential int, payment_type string, payment_installments int, "
        "payment_value decimal(12,2)")
    rows = W.aggregate_payments(pay).collect()
    assert len(rows) == 1
    r = rows[0]
    assert float(r.payment_total) == 75.0 and r.payment_installments_max == 2
    assert r.primary_payment_type == "credit_card" and r.payment_count == 2


def test_grain_pass_and_fail(spark):
    ok = spark.createDataFrame([("o1", 1), ("o2", 1)], "order_id string, order_item_id int")
    bad = spark.createDataFrame([("o1", 1), ("o1", 1)], "order_id string, order_item_id int")
    assert Q.grain_check(ok, ["order_id", "order_item_id"], "f").first().violations == 0
    r = Q.grain_check(bad, ["order_id", "order_item_id"], "f").first()
    assert r.violations == 2 and r.status == "FAIL"


def test_business_rule_negative_price_fails(spark):
    f = spark.createDataFrame([(Decimal("-10.00"), Decimal("5.00"), Decimal("-5.00"), 1)],
                              "price decimal(12,2), freight_value decimal(12,2), total_sales_amount decimal(13,2), "
                              "quantity int")
    res = {r.key: r for r in Q.business_rules(f).collect()}
    assert res["price_non_negative"].status == "FAIL"
    assert res["total_non_negative"].violations == 1
    assert res["freight_non_negative"].status == "PASS"


def test_dense_key_matches_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).cast("string").alias("k")).repartition(7)
    keyed = with_dense_key(df, ["k"], "key").orderBy("k").collect()
    assert [r.key for r in keyed] == list(range(1, 1001))
    assert [r.k for r in keyed] == sorted(r.k for r in keyed)


def test_rule_segments(spark):
    from emporio.config import Params
    io = spark.createDataFrame(
        [("c1", "o1", Decimal("600.00")), ("c2", "o2", Decimal("10.00")), ("c2", "o3", Decimal("10.00")),
         ("c3", "o4", Decimal("10.00")), ("c3", "o4", Decimal("5.00"))],
        "customer_unique_id string, order_id string, total_sales_amount decimal(13,2)")
    seg = {r.customer_unique_id: r.segment for r in W.rule_segments(io, Params(vip_min=500.0)).collect()}
    assert seg == {"c1": "vip", "c2": "repeat", "c3": "new"}


def test_schema_check(spark):
    from emporio.sources.schemas import REQUIRED
    frames = {"orders": spark.createDataFrame([("o1", "c1")], "order_id string, customer_id string")}
    res = {r.dataset: r for r in Q.schema_check(spark, frames, {"orders": REQUIRED["orders"]}).collect()}
    assert res["orders"].status == "FAIL" and res["orders"].violations == len(REQUIRED["orders"]) - 2


def test_warehouse_load_run_and_refresh(spark, tmp_dir):
    import functools
    import os
    from emporio.operators.reporting import refresh_reporting_layer
    from emporio.sources import versions
    from emporio.plans.context import Context
    from emporio.plans.warehouse_load import load_warehouse
    from conftest import SF_SMALL
    ctx = Context.for_fixture(spark, SF_SMALL)
    stages = {r.stage: r for r in load_warehouse(ctx, os.path.join(tmp_dir, "wh")).collect()}
    assert list(stages) == ["geography", "customer", "seller", "product", "date", "fact"]
    current = functools.partial(versions.read_current, spark, os.path.join(tmp_dir, "wh"))
    assert stages["fact"].rows_loaded == current("fact_sales").count()
    assert stages["customer"].warnings > 0          # nation 24 has no geography in the fixture
    keys = current("dim_customer")
    assert keys.agg(F.min("customer_key"), F.max("customer_key")).first() == (1, keys.count())
    counts = refresh_reporting_layer(ctx, os.path.join(tmp_dir, "rep"))
    assert set(counts) == {"reporting_sales_summary", "reporting_category_summary",
                           "reporting_state_summary", "reporting_customer_summary"}
    assert all(v > 0 for v in counts.values())
