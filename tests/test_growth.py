"""What a query moves and writes must not grow faster than its input."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emporio.config import Params
from emporio.operators import clustering as C
from emporio.operators import segmentation as S
from emporio.operators import warehouse as W
from emporio.plans.context import Context

from conftest import SF_SMALL


@pytest.fixture()
def ctx(spark):
    """A context of its own, with nothing built yet."""
    return Context(spark, Context.for_fixture(spark, SF_SMALL).src, Params.for_fixture(), name=os.urandom(8).hex())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_csv_source_writes_no_other_source(ctx):
    from emporio.plans.q_warehouse import csv_source, csv_sources
    payments = csv_source(ctx, "payments")
    base = ctx.scratch("csv_sources").removeprefix("file:")
    written = lambda: {f.removesuffix(".csv") for f in os.listdir(base) if f.endswith(".csv")}
    assert written() == {"payments"}
    assert payments.exceptAll(ctx.src["payments"]).isEmpty() and payments.count() == ctx.src["payments"].count()
    assert set(csv_sources(ctx)) == set(ctx.src) == written()


def test_items_are_not_shuffled_on_sellers_of_a_written_table(spark, ctx):
    """The size of the written sellers is known before the join is planned: only they move."""
    fact = W.enriched_fact(ctx.src, ctx.params, ctx._store)
    moved = [line for line in plan_of(fact).splitlines() if "hashpartitioning(" in line]
    assert moved and not any("seller_id" in line.split("hashpartitioning(")[1].split("),")[0] for line in moved)
    assert sorted(map(str, fact.collect())) == sorted(map(str, W.enriched_fact(ctx.src, ctx.params).collect()))


def test_orders_move_with_their_purchase_day_only(spark, ctx):
    """months, years and the timestamp's string follow from the day and are not shuffled."""
    fact = W.enriched_fact(ctx.src, ctx.params, ctx._store)
    plan = spark._jvm.PythonSQLUtils.explainString(fact._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert any("order_date" in columns for columns in moved)
    assert not any(c in columns for columns in moved for c in ("timestamp", "month", "year", "date_key"))


def test_days_that_cannot_be_read_leave_the_fact_without_a_month(spark, ctx):
    known = ctx.src["orders"].limit(3).collect()
    odd = spark.createDataFrame([r.asDict() | {"order_purchase_timestamp": t} for r, t in
                                 zip(known, [None, "no day", "2000-02-29 23:59:59"])], ctx.src["orders"].schema)
    rows = W.enriched_fact(ctx.src | {"orders": odd}, ctx.params).collect()
    found = {r["order_id"]: tuple(r[c] and str(r[c]) for c in ("order_date", "purchase_date_key", "month_year", "year_number",
                                                              "month_number")) for r in rows}
    nothing = (None,) * 5
    assert found == {known[0]["order_id"]: nothing, known[1]["order_id"]: nothing,
                     known[2]["order_id"]: ("2000-02-29", "20000229", "2000-02", "2000", "2")}


def test_sellers_too_many_to_broadcast_give_the_same_rows(spark, ctx):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(str, W.enriched_fact(ctx.src, ctx.params).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(str, W.enriched_fact(ctx.src, ctx.params, ctx._store).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want


ITEMS = ("customer_unique_id string, order_id string, product_id string, product_category_name_english string, "
         "state_code string, quantity int, total_sales_amount decimal(13,2), freight_value decimal(12,2), order_date date")


def items_of(spark):
    from datetime import date
    from decimal import Decimal as D
    day = lambda n: date(2018, 1, n)
    return spark.createDataFrame([
        # one customer in two places, with the same product, category and order in both
        ("a", "o1", "p1", "x", "SB", 1, D("10.00"), D("1.00"), day(3)), ("a", "o1", "p2", None, "SA", 1, D("5.00"), None, day(3)),
        ("a", "o2", "p1", "x", "SA", 1, D("2.50"), D("0.50"), day(1)), ("a", "o3", None, "x", None, 1, None, D("0.25"), day(9)),
        # no place, no money
        ("b", "o4", "p3", "y", None, 1, None, None, day(2)), (None, "o5", "p1", "x", "SC", 1, D("1.00"), D("1.00"), day(2))], ITEMS)


def test_customer_in_two_places_is_one_customer(spark):
    from datetime import date
    got = {r[0]: tuple(r)[1:] for r in S.customer_aggregates(items_of(spark)).collect()}
    assert got == {"a": (3, 17.5, 17.5 / 3, 4, 2, 1, 1.75 / 3, date(2018, 1, 1), date(2018, 1, 9), "SB"),
                   "b": (1, None, None, 1, 1, 1, None, date(2018, 1, 2), date(2018, 1, 2), "UNKNOWN")}


def test_items_are_not_sorted_for_the_customer_aggregates(spark):
    """Sorting is left to the aggregate of a row per customer and place."""
    plan = plan_of(S.customer_aggregates(items_of(spark)))
    below = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert below and not any("gid" in line or "order_id" in line or "quantity" in line for line in below)


def test_nearest_centre_by_search_and_the_first_of_equal_ones():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (500, 3)).astype(float)
    for k in (1, 2, 7):
        centres = np.repeat(rng.integers(-3, 4, (k, 3)).astype(float), 2, axis=0)   # every centre twice
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        for square in (None, (x * x).sum(axis=1)):
            label, d = C.nearest(x, centres, square)
            assert (label == far.argmin(axis=1)).all() and np.allclose(d, far.min(axis=1))


def test_sums_of_a_pass_over_two_spaces(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 2)), rng.normal(size=(300, 3))
    points = spark.createDataFrame([(u.tolist(), v.tolist()) for u, v in zip(a, b)], "a array<double>, b array<double>")
    centres = {C.Config("a", 2, 0): a[:2], C.Config("b", 3, 0): b[:3], C.Config("a", 3, 0): a[5:8]}
    got = {(r.config, r.label, r.dim): r.total for r in C._sums(points, centres).itertuples()}
    for n, (config, c) in enumerate(centres.items()):
        x = a if config.space == "a" else b
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        for k in range(len(c)):
            own = far.argmin(axis=1) == k
            assert got[n, k, -2] == own.sum() and np.isclose(got[n, k, -1], far[own, k].sum())
            assert np.allclose([got[n, k, i] for i in range(x.shape[1])], x[own].sum(axis=0))


def test_customer_features_make_no_copies_of_the_items(spark):
    """A distinct count beside another one works on a copy of every item for each."""
    assert "Expand" not in plan_of(S.customer_aggregates(items_of(spark)))


def test_the_stored_fact_is_not_sorted_as_a_whole(ctx):
    """Sorting every column of every item is what spilled; only the joins sort, on their keys."""
    seen = []
    store = ctx._store
    ctx._store = lambda df, label: (seen.append((label, plan_of(df))), store(df, label))[1]
    ctx.enriched
    assert not any("month_year" in line for label, plan in seen for line in plan.splitlines() if "Sort [" in line)


def test_items_are_not_sorted_for_the_rows_of_orders(ctx):
    """What items take from their order is grouped by; no greatest string is taken over items."""
    from emporio.operators import cubes, reporting, timeseries
    assert ctx.single_orders
    for df in (cubes.order_categories(ctx.fact, True), reporting.sales_summary(ctx.fact, True),
               timeseries.daily_aggregates(ctx.fact, single=True)):
        assert "SortAggregate" not in plan_of(df)


def test_an_order_with_two_customers_is_one_row(spark):
    from decimal import Decimal as D
    from emporio.functions.order_rows import order_rows
    rows = spark.createDataFrame([("o1", "a", "SA", D("1.10")), ("o1", "b", None, D("2.20")), ("o1", "a", "SA", None),
                                  ("o2", None, "SB", None), ("o3", "c", None, D("4.00"))],
                                 "order_id string, customer string, state string, money decimal(13,2)")
    sums = {"money": F.sum("money"), "items": F.count(F.lit(1)), "priced": F.count("money")}
    got = order_rows(rows, ["order_id"], ["customer", "state"], sums)
    want = rows.groupBy("order_id").agg(F.max("customer").alias("customer"), F.max("state").alias("state"),
                                        *[x.alias(n) for n, x in sums.items()])
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    single = order_rows(rows.where("order_id <> 'o1'"), ["order_id"], ["customer", "state"], sums, single=True)
    assert sorted(map(str, single.select(want.columns).collect())) == sorted(map(str, want.where("order_id <> 'o1'").collect()))


@pytest.mark.parametrize("name, key", [("orders", "order_id"), ("customers", "customer_id")])
def test_a_repeated_order_or_customer_is_seen(spark, ctx, name, key):
    same = ctx.src[name].where(F.col(key).isNotNull()).limit(1)
    assert ctx.single_orders
    twice = Context(spark, ctx.src | {name: ctx.src[name].union(same)}, ctx.params, name=os.urandom(8).hex())
    assert not twice.single_orders
    first = lambda c: sorted(map(str, c.orders.select(sorted(c.orders.columns)).collect()))
    want = (twice.fact.groupBy("order_id").agg(
        *[F.max(c).alias(c) for c in ("customer_unique_id", "segment", "state_code", "month_year")],
        F.sum("total_sales_amount").alias("revenue"), F.sum("quantity").cast("long").alias("quantity"),
        F.sum("freight_value").alias("freight")))
    assert first(twice) == sorted(map(str, want.select(sorted(want.columns)).collect()))


def test_points_are_not_shuffled_for_each_labelling(spark, monkeypatch):
    """centres are few and are sent to the points, whatever the size of the points is taken for."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3)], i % 2, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>, two int, three int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as for points that are too large
    try:
        out = C.dispersion(df, "x", ["two", "three"])
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
        assert moved and not any(re.search(r"(^|, )x#", columns) for columns in moved)
        few = sorted(map(tuple, out.collect()))
        monkeypatch.setattr(C, "SENT_CENTRES", 2)
        many = sorted(map(tuple, C.dispersion(df, "x", ["two", "three"]).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [r[:2] for r in few] == [r[:2] for r in many] == [("three", 3), ("two", 2)]
    assert np.allclose([r[2:] for r in few], [r[2:] for r in many], rtol=1e-9)
