"""Exact quantiles, EWM, sinks, streaming append."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emporio.functions.quantiles import exact_quantiles
from emporio.operators import timeseries as T
from emporio.sources import sinks


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = [float(x) for x in rng.integers(0, 50, 301)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    got = {r.p: r.value for r in exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.8, 1.0]).collect()}
    for p, v in got.items():
        assert abs(v - float(np.quantile(vals, p))) < 1e-9


def test_grouped_quantiles(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", float(i * 2)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.p): r.value for r in exact_quantiles(df, "x", [0.5], group="g").collect()}
    assert got[("a", 0.5)] == 4.5 and got[("b", 0.5)] == 4.0


def test_ewm_matches_pandas_adjusted(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    import datetime as dt
    rows = [("all", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_key string, order_date date, log_daily_revenue double")
    got = [r.e for r in df.withColumn("e", T.ewm_mean("log_daily_revenue", 7)).orderBy("order_date").collect()]
    exp = pd.Series(vals).shift(1).ewm(span=7, adjust=True).mean().tolist()
    assert got[0] is None
    for a, b in zip(got[1:], exp[1:]):
        assert abs(a - b) < 1e-12


def test_paged_report_and_export(spark, tmp_dir):
    df = spark.createDataFrame([(f"2001-{m:02d}", float(m)) for m in range(1, 13)],
                               "order_month string, total_revenue double")
    rows, total = sinks.paged_report(df, "reporting_sales_summary", page=2, page_size=5)
    assert [r.order_month for r in rows.collect()] == [f"2001-{m:02d}" for m in range(6, 11)]
    assert total.first().total_rows == 12
    n = sinks.export_csv(df, "reporting_sales_summary", os.path.join(tmp_dir, "csv"))
    assert n == 12
    assert sinks.export_csv(df, "reporting_sales_summary", os.path.join(tmp_dir, "few"), row_limit=10) == 10
    for page, size in ((0, 5), (1, 501), (1, 0)):
        with pytest.raises(ValueError):
            sinks.paged_report(df, "reporting_sales_summary", page=page, page_size=size)


def test_replace_append_reset(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    df = spark.range(10)
    assert sinks.replace_table(df, path) == 10
    assert sinks.append_table(df, path) == 10
    assert spark.read.parquet(path).count() == 20
    sinks.truncate_table(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_streaming_append_is_replay_safe(spark, tmp_dir):
    from decimal import Decimal
    from emporio.sources.schemas import ORDER_ITEMS
    from emporio.streaming.incremental import start_item_append
    src = os.path.join(tmp_dir, "items")
    items = spark.createDataFrame(
        [("o1", 1, "p1", "s1", "2001-01-01 00:00:00", Decimal("10.00"), Decimal("1.2345")),
         ("o2", 1, "p2", "s1", "2001-01-02 00:00:00", Decimal("20.00"), Decimal("0.0000"))], ORDER_ITEMS)
    items.write.mode("overwrite").parquet(src)
    orders = spark.createDataFrame([("o1", "c1", "2001-01-01 10:00:00"), ("o2", "c2", "2001-01-02 11:00:00")],
                                   "order_id string, customer_id string, order_purchase_timestamp string")
    out, ck = os.path.join(tmp_dir, "fact"), os.path.join(tmp_dir, "ck")
    q = start_item_append(spark, src, orders, out, ck)
    q.awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 2
    assert sorted(float(r.freight_value) for r in first.collect()) == [0.0, 1.23]
    q2 = start_item_append(spark, src, orders, out, ck)   # nothing new: no duplicates
    q2.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_ewm_blocks_equal_fold(spark):
    import datetime as dt
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), float((i * 37 + len(k)) % 11))
            for k in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "series_key string, order_date date, log_daily_revenue double")
    a = T.ewm_features(df, method="blocks").orderBy("series_key", "order_date").collect()
    b = T.ewm_features(df, method="fold").orderBy("series_key", "order_date").collect()
    for x, y in zip(a, b):
        for w in T.ROLLING_WINDOWS:
            c = f"log_rev_roll_ema_{w}"
            assert (x[c] is None and y[c] is None) or abs(x[c] - y[c]) < 1e-9


def test_ewm_state_continues_the_series(spark):
    import datetime as dt
    vals = [float((i * 13) % 7) for i in range(40)]
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_key string, order_date date, log_daily_revenue double")
    st = T.ewm_state(df).first()
    # EWM feature of the day after the last one = fold over all 40 values
    exp = pd.Series(vals + [0.0]).shift(1).ewm(span=14, adjust=True).mean().iloc[-1]
    assert abs(st["_num_14"] / st["_den_14"] - exp) < 1e-9


def test_recursive_forecast_equals_full_history_rebuild(spark):
    """Tail window + exact EWM state gives the same forecasts as rebuilding all features."""
    from emporio.operators import forecasting as FC
    from emporio.plans import q_timeseries as QT
    from emporio.plans.context import Context
    from conftest import SF_SMALL
    ctx = Context.for_fixture(spark, SF_SMALL)
    data, cols = QT._prepared(ctx)
    m = FC.make_estimator("random_forest", {"numTrees": 5, "maxDepth": 4}).fit(data.where("split = 'train'"))
    ts = T.apply_cutoff(QT.series(ctx))
    fast = {r.order_date: r.pred for r in FC.recursive_forecast(ts, m, cols, horizon=2).collect()}
    base = ts.select("series_key", "order_date", *FC.CARRIED, "daily_revenue")
    lastrow = base.orderBy(F.desc("order_date")).limit(1)
    hist = base
    for step in (1, 2):
        new = lastrow.select("series_key", F.date_add("order_date", step).alias("order_date"), *FC.CARRIED,
                             F.lit(0.0).alias("daily_revenue"))
        feats = T.build_features(T.add_drivers(hist.unionByName(new)))
        tgt = feats.join(new.select("series_key", "order_date"), ["series_key", "order_date"])
        p = m.transform(FC.assemble(tgt, cols)).select(
            "order_date", F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("p")).first()
        assert abs(fast[p.order_date] - p.p) <= 1e-9 * max(1.0, abs(p.p))
        hist = hist.unionByName(new.withColumn("daily_revenue", F.lit(p.p)))


def test_exact_quantiles_with_a_hot_value(spark):
    """97 % equal values: one row after counting, so no partition holds them all."""
    from pyspark.sql import functions as F
    df = spark.range(40_000).select(F.when(F.col("id") % 100 < 97, 5.0).otherwise(F.col("id") / 7.0).alias("x"),
                                    (F.col("id") % 3).alias("g"))
    rows = df.collect()
    probs = [0.0, 0.01, 0.25, 0.5, 0.97, 0.985, 1.0]
    for r in exact_quantiles(df, "x", probs).collect():
        assert r.value == pytest.approx(np.quantile([v.x for v in rows], r.p))
    for r in exact_quantiles(df, "x", probs, group="g").collect():
        assert r.value == pytest.approx(np.quantile([v.x for v in rows if v.g == r.g], r.p))
    assert exact_quantiles(df.where("x < 0"), "x", probs).collect() == []


def test_csv_quotes_line_breaks_and_column_order(spark, tmp_dir):
    from emporio.sources.csv import load_source
    from emporio.sources.schemas import SOURCES
    cols = list(reversed(SOURCES["reviews"].names))
    values = {"review_id": "r1", "order_id": "o1", "review_score": "4", "review_comment_title": '"say ""hi"", ok"',
              "review_comment_message": '"first\nsecond, line"', "review_creation_date": "2018-01-01 00:00:00",
              "review_answer_timestamp": "2018-01-02 00:00:00"}
    second = {**values, "review_id": "r2", "review_comment_title": "", "review_comment_message": "plain"}
    with open(os.path.join(tmp_dir, "reviews.csv"), "w") as f:
        for row in (dict(zip(cols, cols)), values, second):
            f.write(",".join(row[c] for c in cols) + "\n")
    got = load_source(spark, tmp_dir, "reviews").orderBy("review_id").collect()
    assert [r.review_id for r in got] == ["r1", "r2"] and got[0].review_score == 4
    assert got[0].review_comment_title == 'say "hi", ok' and got[0].review_comment_message == "first\nsecond, line"
    with open(os.path.join(tmp_dir, "sellers.csv"), "w") as f:
        f.write("seller_city,seller_id,seller_state\nx,s,SP\n")
    with pytest.raises(ValueError):
        load_source(spark, tmp_dir, "sellers")


def test_parameters_do_not_depend_on_the_path():
    from emporio.config import Params
    assert Params.for_fixture() == Params.for_fixture()
    assert Params.for_fixture().near_empty_month_share == 0.1
