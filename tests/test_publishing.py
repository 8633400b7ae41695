"""Tables published together, the audited load run, and late orders of the streaming append."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emporio.operators import quality as Q
from emporio.operators import reporting as R
from emporio.plans import warehouse_load as L
from emporio.plans.context import Context
from emporio.sources import versions
from emporio.sources.schemas import ORDER_ITEMS
from emporio.streaming.incremental import append_batch, start_item_append

from conftest import SF_SMALL


def test_failure_in_the_third_table_leaves_all_old_ones(spark, tmp_dir, monkeypatch):
    ctx = Context.for_fixture(spark, SF_SMALL)
    R.refresh_reporting_layer(ctx, tmp_dir)
    before = {t: sorted(map(str, versions.read_current(spark, tmp_dir, t).collect())) for t in R.REPORTING_TABLES}

    def broken(df):
        return df.select(F.raise_error(F.lit("injected")).alias("state_code"))

    third = list(R.REPORTING_TABLES)[2]
    monkeypatch.setitem(R.REPORTING_TABLES, "reporting_sales_summary", ("fact", lambda f: R.sales_summary(f).limit(1)))
    monkeypatch.setitem(R.REPORTING_TABLES, third, ("enriched", broken))
    with pytest.raises(Exception, match="injected"):
        R.refresh_reporting_layer(ctx, tmp_dir)
    for t, rows in before.items():
        assert sorted(map(str, versions.read_current(spark, tmp_dir, t).collect())) == rows
    assert versions.newest(spark, tmp_dir)["version"] == 1
    monkeypatch.setitem(R.REPORTING_TABLES, third, ("enriched", R.state_summary))
    R.refresh_reporting_layer(ctx, tmp_dir)
    assert versions.newest(spark, tmp_dir)["version"] == 2
    assert versions.read_current(spark, tmp_dir, "reporting_sales_summary").count() == 1


def test_nothing_is_read_before_a_publish(spark, tmp_dir):
    with pytest.raises(LookupError):
        versions.read_current(spark, os.path.join(tmp_dir, "none"), "t")

    def audit(draft):
        raise versions.AuditFailed("no")

    with pytest.raises(versions.AuditFailed):
        versions.replace_together(spark, tmp_dir, {"t": lambda: spark.range(3)}, audit)
    assert versions.newest(spark, tmp_dir) is None
    versions.replace_together(spark, tmp_dir, {"t": lambda: spark.range(3)})
    with pytest.raises(LookupError):
        versions.read_current(spark, tmp_dir, "other")
    assert versions.read_current(spark, tmp_dir, "t").count() == 3


def changed(ctx, **sources):
    return Context(ctx.spark, {**ctx.src, **sources}, ctx.params, name=f"changed-{sorted(sources)}", materialize=False)


def test_a_failing_stage_is_recorded_and_not_published(spark, tmp_dir):
    ctx = Context.for_fixture(spark, SF_SMALL)
    _, findings, version = L.run_load(ctx, tmp_dir)
    assert version == 1 and not [f for f in findings if f[4] == Q.FAIL]
    rows = versions.read_current(spark, tmp_dir, "fact_sales").count()
    items = ctx.src["order_items"]
    bad = changed(ctx, order_items=items.withColumn("price", F.when(F.col("order_item_id") == 1, -F.col("price")).otherwise(F.col("price"))))
    metrics, findings, version = L.run_load(bad, tmp_dir)
    status = {r[0]: r[5] for r in metrics.rows}
    assert version is None and status["fact"] == "FAILED" and status["customer"] == "SUCCESS"
    assert {f[2] for f in findings if f[4] == Q.FAIL} == {"price_negative", "total_negative"}
    assert versions.newest(spark, tmp_dir)["version"] == 1
    assert versions.read_current(spark, tmp_dir, "fact_sales").count() == rows
    with pytest.raises(versions.AuditFailed, match="price_negative"):
        L.load_warehouse(bad, tmp_dir)


def test_schema_grain_and_totals_stop_the_load(spark, tmp_dir):
    ctx = Context.for_fixture(spark, SF_SMALL)
    metrics, findings, version = L.run_load(changed(ctx, sellers=ctx.src["sellers"].drop("seller_city")), tmp_dir)
    assert version is None and findings[-1][:3] == ("schema", "sellers", "seller_city")
    assert [r[0] for r in metrics.rows] == ["geography", "customer", "seller"] and metrics.rows[-1][5] == "FAILED"
    twice = changed(ctx, customers=ctx.src["customers"].unionByName(ctx.src["customers"].limit(2)))
    _, findings, version = L.run_load(twice, tmp_dir)
    assert version is None and ("grain", "dim_customer", "customer_id", 4, Q.FAIL) in findings
    # an item without its order gets lost in the fact: the totals differ
    lost = changed(ctx, orders=ctx.src["orders"].orderBy("order_id").offset(1))
    _, findings, version = L.run_load(lost, tmp_dir)
    assert version is None and {f[2] for f in findings if f[4] == Q.FAIL} == {"price", "freight_value"}


def test_source_is_read_once_per_stage(spark, tmp_dir):
    """Rows extracted come from the read that builds the table."""
    ctx = Context.for_fixture(spark, SF_SMALL)
    metrics, _, _ = L.run_load(ctx, tmp_dir)
    for name, extracted, *_ in metrics.rows:
        source = next(s.source for s in L.STAGES if s.name == name)
        assert extracted == ctx.src[source].count()


def test_items_and_orders_are_not_planned_twice_on_items(spark):
    """Item rows meet three shuffles at most when nothing is broadcast."""
    ctx = Context.for_fixture(spark, SF_SMALL)
    from emporio.operators import warehouse as W
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = W.enriched_fact(ctx.src, ctx.params)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Scan parquet") and plan.count("lineitem") <= 4   # items, and their revenue per order


def test_null_keys_match_nothing_and_are_spread(spark):
    from emporio.operators import warehouse as W
    rows = spark.createDataFrame([(f"o{i}", None if i % 2 else "p1") for i in range(50)], "order_id string, product_id string")
    dim = spark.createDataFrame([("p1", 1), (None, 2)], "product_id string, k int")
    out = W.looked_up(rows, dim, "product_id").collect()
    assert len(out) == 50 and {(r["product_id"], r["k"]) for r in out} == {("p1", 1), (None, None)}


# --- A5 ------------------------------------------------------------------------------
def item(order, n=1):
    return (order, n, "p1", "s1", "2001-01-01 00:00:00", Decimal("10.00"), Decimal("1.0000"))


def known(spark, *ids):
    return spark.createDataFrame([(i, f"c{i}", "2001-01-01 10:00:00") for i in ids] or [],
                                 "order_id string, customer_id string, order_purchase_timestamp string")


def test_an_order_two_batches_late(spark, tmp_dir):
    out, waiting = os.path.join(tmp_dir, "fact"), os.path.join(tmp_dir, "waiting")
    batches = [([item("o1"), item("o2")], ["o1"]), ([item("o3")], ["o1", "o3"]), ([item("o4"), item(None)], ["o1", "o2", "o3", "o4"])]
    for n, (items, orders) in enumerate(batches):
        append_batch(spark.createDataFrame(items, ORDER_ITEMS), n, known(spark, *orders), out, waiting)
    got = sorted((r.batch_id, r.order_id) for r in spark.read.parquet(out).collect())
    assert got == [(0, "o1"), (1, "o3"), (2, "o2"), (2, "o4")]
    assert [r.order_id for r in spark.read.parquet(f"{waiting}/batch_id=2").collect()] == [None]
    # the second batch is run again, as after a failure: the same rows, none doubled
    append_batch(spark.createDataFrame(batches[1][0], ORDER_ITEMS), 1, known(spark, "o1", "o3"), out, waiting)
    assert sorted((r.batch_id, r.order_id) for r in spark.read.parquet(out).collect()) == got


def test_a_replayed_batch_of_the_stream(spark, tmp_dir):
    """The stream is started again without the commit of its last batch, so that this runs a second time."""
    src, out, ck = (os.path.join(tmp_dir, n) for n in ("items", "fact", "ck"))
    orders = {"known": ["o1"]}

    def current():
        return known(spark, *orders["known"])

    for ids, late in ((["o1", "o2"], ["o1"]), (["o3"], ["o1", "o2", "o3"])):
        spark.createDataFrame([item(i) for i in ids], ORDER_ITEMS).coalesce(1).write.mode("append").parquet(src)
        orders["known"] = late
        start_item_append(spark, src, current, out, ck).awaitTermination()
    want = [(0, "o1"), (1, "o2"), (1, "o3")]
    assert sorted((r.batch_id, r.order_id) for r in spark.read.parquet(out).collect()) == want
    for name in ("1", ".1.crc"):
        path = os.path.join(ck, "commits", name)
        if os.path.exists(path):
            os.remove(path)
    start_item_append(spark, src, current, out, ck).awaitTermination()
    assert os.path.exists(os.path.join(ck, "commits", "1"))
    assert sorted((r.batch_id, r.order_id) for r in spark.read.parquet(out).collect()) == want
