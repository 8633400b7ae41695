"""Edge cases listed in FIXTURES.md section 2 ("add ourselves")."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from emporio.config import Params
from emporio.operators import insights as G
from emporio.operators import segmentation as S
from emporio.operators import timeseries as T


def test_diebold_mariano_constant_loss_difference(spark):
    # identical errors -> d = 0 everywhere -> sd 0 -> (0, 1)
    df = spark.createDataFrame([("all", 1.0, 1.0), ("all", 2.0, 2.0), ("all", 3.0, 3.0)],
                               "series_key string, e1 double, e2 double")
    r = T.diebold_mariano(df, "e1", "e2").first()
    assert r.dm_stat == 0.0 and r.p_value == 1.0


def test_normal_cdf_accuracy(spark):
    import math
    xs = [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(T.normal_cdf(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert abs(p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-7


def test_growth_with_previous_zero_is_null(spark):
    df = spark.createDataFrame([(0.0, 10.0), (None, 5.0), (4.0, 5.0)], "prev double, cur double")
    got = [r.g for r in df.select(G.growth_pct(F.col("cur"), F.col("prev")).alias("g")).collect()]
    assert got[0] is None and got[1] is None and abs(got[2] - 25.0) < 1e-12


def test_drift_denominator_for_zero_std(spark):
    stats = spark.createDataFrame([("all", "f", 200.0, 0.0), ("all", "g", 0.0, 0.0)],
                                  "series_key string, feature string, mean double, std double")
    days = [("all", dt.date(2020, 1, 1) + dt.timedelta(days=i), 202.0, 1.0) for i in range(5)]
    ready = spark.createDataFrame(days, "series_key string, order_date date, f double, g double")
    z = {r.feature: r.z_score for r in T.drift_features(ready, stats, ["f", "g"], window=5).collect()}
    assert z["f"] == 1.0          # (202 - 200) / (1 % of 200)
    assert z["g"] == 1.0          # mean 0 -> denominator 1


def test_customer_with_two_customer_ids_is_one_person(spark):
    rows = [("o1", "p1", "c1", "u1", Decimal("10.00"), Decimal("1.00"), 1, dt.date(2018, 1, 1), "SP", "toys"),
            ("o2", "p2", "c2", "u1", Decimal("20.00"), Decimal("2.00"), 1, dt.date(2018, 2, 1), "SP", "books")]
    enriched = spark.createDataFrame(
        rows, "order_id string, product_id string, customer_id string, customer_unique_id string, "
              "total_sales_amount decimal(13,2), freight_value decimal(12,2), quantity int, order_date date, "
              "state_code string, product_category_name_english string")
    r = S.customer_aggregates(enriched).first()
    assert r.customer_unique_id == "u1" and r.number_of_orders == 2 and r.unique_categories == 2
    f = S.behaviour_features(S.customer_aggregates(enriched), Params(rfm_reference_date="2018-03-01")).first()
    assert f.recency_days == 28 and f.customer_tenure_days == 31


def test_rfm_with_tied_quintile_edges(spark):
    # many equal revenues: several edges coincide; equal values always get equal scores
    vals = [100.0] * 6 + [200.0] * 2 + [300.0, 400.0]
    rows = [(f"u{i}", 10 + i, 1 + (i % 3), v) for i, v in enumerate(vals)]
    feats = spark.createDataFrame(rows, "customer_unique_id string, recency_days int, number_of_orders long, "
                                        "total_revenue double")
    scores = {r.customer_unique_id: r for r in S.rfm_scores(feats).collect()}
    assert len({scores[f"u{i}"].m_score for i in range(6)}) == 1
    assert scores["u9"].m_score == 5 and scores["u0"].m_score == 1
    assert all(1 <= s.r_score <= 5 and 1 <= s.f_score <= 4 for s in scores.values())


def test_constant_series_rolling_std_is_zero(spark):
    days = [("all", dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0, 5.0) for i in range(10)]
    df = spark.createDataFrame(days, "series_key string, order_date date, log_daily_revenue double, daily_revenue double")
    r = T.rolling_features(df, windows=[7]).orderBy("order_date").collect()
    assert r[6].log_rev_roll_std_7 is None           # only 6 previous days
    assert r[7].log_rev_roll_std_7 == 0.0 and r[7].log_rev_roll_mean_7 == 5.0


def test_context_memo_builds_once_across_threads(spark):
    from concurrent.futures import ThreadPoolExecutor
    from emporio.plans.context import Context
    ctx = Context(spark, {}, Params(), name="memo-test", materialize=False)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    with ThreadPoolExecutor(max_workers=8) as pool:
        results = list(pool.map(lambda _: ctx.memo("t", build), range(16)))
    assert len(calls) == 1 and all(r is results[0] for r in results)
