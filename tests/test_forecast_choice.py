"""Weights, blend, champion, importance and the array-state forecast against plain Python."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emporio.operators import forecasting as FC
from emporio.operators import timeseries as T


def predictions(spark, skip=()):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for split, days in (("valid", 12), ("test", 6)):
        for d in range(days):
            y = float(np.exp(rng.normal(6, 0.4)))
            truth[split, d] = y
            for k, m in enumerate(("gbt", "linear", "naive", "random_forest")):
                if (m, split, d) not in skip:
                    rows.append((m, split, "all", dt.date(2020, 1 if split == "valid" else 2, d + 1), y,
                                 math.log1p(y) + float(rng.normal(0, 0.1 * (k + 1)))))
    return spark.createDataFrame(rows, "model string, split string, series_key string, order_date date, y double, pred_log double"), rows


def test_weights_blend_and_champion(spark):
    preds, rows = predictions(spark, skip={("linear", "test", 3)})
    rmse = {}
    for m in {r[0] for r in rows}:
        own = [(r[4], math.expm1(r[5])) for r in rows if r[0] == m and r[1] == "valid"]
        rmse[m] = math.sqrt(sum((y - p) ** 2 for y, p in own) / len(own))
    top = sorted(rmse, key=rmse.get)[:3]
    total = sum(1 / rmse[m] for m in top)
    w = FC.blend_weights(preds)
    got = {r["model"]: (r["rank"], r["weight"], r["valid_rmse"]) for r in w.collect()}
    assert got == {m: (i + 1, pytest.approx(1 / rmse[m] / total), pytest.approx(rmse[m])) for i, m in enumerate(top)}
    days = {}
    for m, split, _, d, y, p in rows:
        if m in top:
            days.setdefault((split, d), []).append((y, p / rmse[m] / total))
    want = {k: (v[0][0], sum(p for _, p in v)) for k, v in days.items() if len(v) == 3}
    out = {(r["split"], r["order_date"]): (r["y"], r["pred_log"]) for r in FC.blend(preds, w).collect()}
    assert out == {k: (y, pytest.approx(p)) for k, (y, p) in want.items()}
    assert ("linear" in top) == (("test", dt.date(2020, 2, 4)) not in out)
    ens = math.sqrt(np.mean([(y - math.expm1(p)) ** 2 for (s, _), (y, p) in want.items() if s == "valid"]))
    gain = 1 - ens / rmse[top[0]]
    for threshold, name in ((gain - 1e-6, "ensemble"), (gain + 1e-6, top[0])):
        c = FC.champion(preds, w, threshold).first()
        assert c["champion"] == name and c["gain"] == pytest.approx(gain)


def test_best_of_family_takes_one_trial_each():
    fits = [FC.Fitted("gbt", {"maxDepth": d}, None, r) for d, r in ((3, 5.0), (4, 2.0), (5, 2.0))]
    fits += [FC.Fitted("linear", {}, None, 9.0)]
    best = FC.best_of_family(fits)
    assert [(f.name, f.params.get("maxDepth"), f.valid_rmse) for f in best] == [("gbt", 4, 2.0), ("linear", None, 9.0)]


@pytest.mark.parametrize("n", [2, 3, 41])
def test_importance_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 4))
    label = 2 * x[:, 0] - x[:, 2] + rng.normal(0, 0.1, n)
    rows = [(f"k{i}", float(label[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, label double, x array<double>").repartition(3)

    def predict(d):
        return d.withColumn("prediction", F.get("x", F.lit(0)) * 2.0 - F.get("x", F.lit(2)) * 0.9)

    cols = ["a", "b", "c", "d"]
    got = {r["feature"]: (r["rise"], r["importance"])
           for r in FC.permutation_importance(df, cols, ["k"], predict, repeats=4, seed=7).collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"7:k{i}".encode()).hexdigest())
    x, label = x[order], label[order]
    of = lambda v: np.mean((label - (2 * v[:, 0] - 0.9 * v[:, 2])) ** 2)
    rise = []
    for j in range(4):
        errors = []
        for r in range(1, 5):
            v = x.copy()
            v[:, j] = x[(np.arange(n) + 1 + (r * 7919) % (n - 1)) % n, j]
            errors.append(of(v) - of(x))
        rise.append(np.mean(errors))
    gain = np.maximum(rise, 0)
    share = gain / gain.sum() * 100 if gain.sum() > 0 else gain
    assert got == {c: (pytest.approx(rise[j], abs=1e-9), pytest.approx(share[j], abs=1e-6)) for j, c in enumerate(cols)}
    assert got["b"][0] == pytest.approx(0, abs=1e-12)


class Rule:
    """A stand-in for a fitted model: a function of three features."""

    def __init__(self, out="prediction"):
        self.predictionCol, self.out = "prediction", out

    def copy(self, extra):
        return Rule(next(iter(extra.values())))

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array
        v = vector_to_array("features")
        return df.withColumn(self.out, v[0] * 0.6 + v[1] * 0.3 + F.coalesce(F.nanvl(v[2], F.lit(0.0)), F.lit(0.0)) * 0.1)


def test_forecast_of_several_series_equals_rebuild(spark):
    """Array state against the feature table of the whole history, day by day; one series is short."""
    rng = np.random.default_rng(9)
    start = dt.date(2020, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), *[float(v) for v in rng.integers(1, 50, 6)], float(rng.integers(1, 9)), float(rng.integers(0, 900)))
            for k, n in (("a", 130), ("b", 95), ("c", 20)) for i in range(n)]
    schema = "series_key string, order_date date, " + ", ".join(f"{c} double" for c in FC.CARRIED) + ", daily_revenue double"
    ts = T.add_drivers(spark.createDataFrame(rows, schema))
    cols = ["log_rev_lag_1", "log_rev_roll_ema_14", "log_rev_roll_std_30"]
    got = {(r["series_key"], r["order_date"]): r["pred"] for r in FC.recursive_forecast(ts, Rule(), cols, horizon=5, steps=2).collect()}
    assert len(got) == 15
    hist = ts.select("series_key", "order_date", *FC.CARRIED, "daily_revenue")
    last = {k: max((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in "abc"}
    for step in range(1, 6):
        new = spark.createDataFrame([(k, r[1] + dt.timedelta(days=step), *r[2:9], 0.0) for k, r in last.items()], schema)
        days = {(k, r[1] + dt.timedelta(days=step)) for k, r in last.items()}
        feats = T.build_features(T.add_drivers(hist.unionByName(new))).select("series_key", "order_date", *cols)
        done = []
        for r in feats.collect():
            if (r["series_key"], r["order_date"]) in days:
                p = max(0.0, math.expm1(0.6 * r[cols[0]] + 0.3 * r[cols[1]] + 0.1 * (r[cols[2]] or 0.0)))
                assert got[r["series_key"], r["order_date"]] == pytest.approx(p, rel=1e-9)
                k, row = r["series_key"], last[r["series_key"]]
                done.append((k, r["order_date"], *row[2:9], p))
        hist = hist.unionByName(spark.createDataFrame(done, schema))


def test_all_features_of_a_day_equal_the_feature_table(spark):
    """Every feature that the state gives for the next day is the one of the feature table."""
    rng = np.random.default_rng(2)
    start = dt.date(2020, 10, 20)
    rows = [("a", start + dt.timedelta(days=i), *[float(v) for v in rng.integers(1, 50, 7)], float(rng.integers(0, 900)))
            for i in range(120)]
    schema = "series_key string, order_date date, " + ", ".join(f"{c} double" for c in FC.CARRIED) + ", daily_revenue double"
    ts = T.add_drivers(spark.createDataFrame(rows, schema))
    nxt = spark.createDataFrame([("a", start + dt.timedelta(days=120), *rows[-1][2:9], 0.0)], schema)
    table = T.build_features(T.add_drivers(ts.select(nxt.columns).unionByName(nxt)))
    cols = T.feature_columns(table)
    want = table.where(F.col("order_date") == start + dt.timedelta(days=120)).first()
    seen = {}

    class Spy(Rule):
        def copy(self, extra):
            return Spy(next(iter(extra.values())))

        def transform(self, df):
            seen["features"] = df.select("features")
            return df.withColumn(self.out, F.lit(1.0))

    FC.forecast_step(FC.forecast_state(ts), [(Spy(), 1.0)], cols)
    got = seen["features"].first()["features"].toArray()
    assert len(cols) > 100
    for c, v in zip(cols, got):
        assert v == pytest.approx(float(want[c]), rel=1e-9, abs=1e-9), c
