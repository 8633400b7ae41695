"""H registrations.

Deterministic operators (H1-H17, H22, H25, H26, H29-H34) are checked
against SQL generated from the same feature lists; baseline forecasts
(naive, 7-day MA) stand in for a model where an operator needs
predictions.  Model fits (H18-H21, H23, H24, H27, H28) get a rows check.
Floating-point features are rounded to 6 decimals on both sides
(summation order differs between engines).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..operators import forecasting as FC
from ..operators import timeseries as T
from .oracle import with_base
from .registry import register

R = 6
INT_FEATURES = ["year", "quarter", "month", "week_of_year", "day_of_month", "day_of_week", "day_of_year",
                "weekend_flag", "month_start", "month_end", "quarter_start", "quarter_end", "black_friday_week",
                "christmas_season", "new_year_day", "mothers_day", "fathers_day", "time_index"]


ROUND_MARKS = ("log", "sin", "cos", "roll_mean", "roll_std", "ema", "ma7")


def noisy(name: str) -> bool:
    """Columns whose last bits depend on the engine (transcendentals, float sums in
    windows).  Exact divisions of exact sums are left alone: rounding those could
    split an exact tie differently in the two engines."""
    return any(m in name for m in ROUND_MARKS)


def rounded(df: DataFrame, digits: int = R, cols: list[str] | None = None) -> DataFrame:
    """Round the engine-dependent DOUBLE columns (or the given ones) to ``digits``."""
    pick = (lambda c: c in cols) if cols is not None else noisy
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" and pick(c) else F.col(c)
                       for c, t in df.dtypes])


# --- Spark side: shared per-context tables ------------------------------------------------------
def series(ctx, by: str | None = None) -> DataFrame:
    return T.daily_series(ctx.fact, by, ctx.single_orders)


def features(ctx) -> DataFrame:
    """Feature table of the company series (cutoff applied), materialised once."""
    return ctx.memo("ts_features", lambda: ctx._store(T.build_features(T.apply_cutoff(series(ctx))),
                                                      "ts_features"))


def ready(ctx) -> DataFrame:
    return T.model_ready(features(ctx))


def with_baselines(ctx) -> DataFrame:
    return T.temporal_split(T.baselines(features(ctx)), ctx.params)


def baseline_preds(ctx) -> DataFrame:
    b = with_baselines(ctx)
    return T.long_predictions(b, {"naive": "pred_naive", "ma7": "pred_ma7_log"}).join(
        b.select("series_key", "order_date", "split"), ["series_key", "order_date"])


# --- SQL side ----------------------------------------------------------------------------------
W = "PARTITION BY series_key ORDER BY order_date"


def _series_ctes(by: str | None = None) -> str:
    key = f"CAST({by} AS VARCHAR)" if by else "'all'"
    return f"""
dd AS (SELECT {key} AS series_key, order_date, CAST(count(DISTINCT order_id) AS DOUBLE) AS total_orders,
              CAST(count(*) AS DOUBLE) AS total_items, CAST(count(DISTINCT customer_id) AS DOUBLE) AS total_customers,
              CAST(count(DISTINCT seller_id) AS DOUBLE) AS total_sellers,
              CAST(sum(total_sales_amount) AS DOUBLE) AS daily_revenue,
              CAST(sum(price) AS DOUBLE) / count(price) AS avg_item_price,
              CAST(sum(freight_value) AS DOUBLE) AS total_freight,
              CAST(sum(freight_value) AS DOUBLE) / count(freight_value) AS avg_freight
       FROM fact GROUP BY 1, 2),
grid AS (SELECT series_key, CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE)
                AS order_date FROM dd GROUP BY series_key),
ts0 AS (SELECT g.series_key, g.order_date, {", ".join(f"COALESCE(d.{m}, 0.0) AS {m}" for m in T.MEASURES)}
        FROM grid g LEFT JOIN dd d ON g.series_key = d.series_key AND g.order_date = d.order_date),
ts AS (SELECT *, total_items / greatest(total_orders, 1.0) AS avg_items_per_order,
              daily_revenue / greatest(total_orders, 1.0) AS avg_order_value,
              ln(1 + daily_revenue) AS log_daily_revenue FROM ts0),
rv AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY order_date DESC) AS rr FROM ts),
tail AS (SELECT series_key, sum(total_sellers) / count(*) AS tail_mean, max(order_date) AS last_day
         FROM rv WHERE rr <= {T.CUTOFF_TRAIL_WINDOW} GROUP BY 1),
cut AS (SELECT rv.series_key,
               COALESCE(max(CASE WHEN total_sellers >= {T.CUTOFF_SELLER_RATIO} * tail_mean THEN order_date END),
                        max(last_day)) AS cutoff_date
        FROM rv JOIN tail ON rv.series_key = tail.series_key GROUP BY 1),
tsc AS (SELECT ts.* FROM ts JOIN cut ON ts.series_key = cut.series_key WHERE ts.order_date <= cut.cutoff_date)"""


def _full(w: int, agg: str) -> str:
    fr = f"OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(*) {fr} = {w} THEN {agg} {fr} END"


def _ewm(col: str, span: int) -> str:
    r = repr(1.0 - 2.0 / (span + 1.0))
    h = f"list({col}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"list_sum(list_transform(range(len({h})), lambda i: ({h})[i + 1] * pow({r}, len({h}) - 1 - i)))"
            f" / list_sum(list_transform(range(len({h})), lambda i: pow({r}, len({h}) - 1 - i)))")


def feature_select() -> list[tuple[str, str]]:
    """(name, SQL expression) of every feature, in build_features order."""
    tau = 2 * math.pi
    d = "order_date"
    f = [("year", f"CAST(year({d}) AS INTEGER)"), ("quarter", f"CAST(quarter({d}) AS INTEGER)"),
         ("month", f"CAST(month({d}) AS INTEGER)"), ("week_of_year", f"CAST(weekofyear({d}) AS INTEGER)"),
         ("day_of_month", f"CAST(day({d}) AS INTEGER)"), ("day_of_week", f"CAST(isodow({d}) AS INTEGER)"),
         ("day_of_year", f"CAST(dayofyear({d}) AS INTEGER)"),
         ("weekend_flag", f"CAST(isodow({d}) >= 6 AS INTEGER)"), ("month_start", f"CAST(day({d}) = 1 AS INTEGER)"),
         ("month_end", f"CAST({d} = last_day({d}) AS INTEGER)"),
         ("quarter_start", f"CAST(month({d}) IN (1, 4, 7, 10) AND day({d}) = 1 AS INTEGER)"),
         ("quarter_end", f"CAST(month({d}) IN (3, 6, 9, 12) AND {d} = last_day({d}) AS INTEGER)"),
         ("day_sin", f"sin({tau!r} * isodow({d}) / 7.0)"), ("day_cos", f"cos({tau!r} * isodow({d}) / 7.0)"),
         ("month_sin", f"sin({tau!r} * month({d}) / 12.0)"), ("month_cos", f"cos({tau!r} * month({d}) / 12.0)"),
         ("black_friday_week", f"CAST(month({d}) = 11 AND day({d}) BETWEEN 20 AND 30 AS INTEGER)"),
         ("christmas_season", f"CAST(month({d}) = 12 AND day({d}) BETWEEN 18 AND 25 AS INTEGER)"),
         ("new_year_day", f"CAST(month({d}) = 1 AND day({d}) = 1 AS INTEGER)"),
         ("mothers_day", f"CAST(month({d}) = 5 AND day({d}) BETWEEN 8 AND 14 AND isodow({d}) = 7 AS INTEGER)"),
         ("fathers_day", f"CAST(month({d}) = 8 AND day({d}) BETWEEN 8 AND 14 AND isodow({d}) = 7 AS INTEGER)")]
    for k in range(1, 4):
        f.append((f"fourier_sin_{k}", f"sin({2 * math.pi * k!r} * dayofyear({d}) / 365.25)"))
        f.append((f"fourier_cos_{k}", f"cos({2 * math.pi * k!r} * dayofyear({d}) / 365.25)"))
    for lag in T.LAG_DAYS:
        for name, col in (("log_rev", "log_daily_revenue"), ("rev", "daily_revenue"), ("orders", "total_orders"),
                          ("customers", "total_customers"), ("aov", "avg_order_value")):
            f.append((f"{name}_lag_{lag}", f"lag({col}, {lag}) OVER ({W})"))
    for w in T.ROLLING_WINDOWS:
        f += [(f"log_rev_roll_mean_{w}", _full(w, "avg(log_daily_revenue)")),
              (f"rev_roll_mean_{w}", _full(w, "avg(daily_revenue)")),
              (f"log_rev_roll_std_{w}", _full(w, "stddev_samp(log_daily_revenue)")),
              (f"log_rev_roll_min_{w}", _full(w, "min(log_daily_revenue)")),
              (f"log_rev_roll_max_{w}", _full(w, "max(log_daily_revenue)"))]
    for w in T.ROLLING_WINDOWS:
        f.append((f"log_rev_roll_ema_{w}", _ewm("log_daily_revenue", w)))
    f += [("orders_prev_day", f"lag(total_orders, 1) OVER ({W})"),
          ("aov_prev_day", f"lag(avg_order_value, 1) OVER ({W})"),
          ("customers_prev_day", f"lag(total_customers, 1) OVER ({W})"),
          ("items_prev_day", f"lag(total_items, 1) OVER ({W})"),
          ("items_per_order_prev_day", f"lag(avg_items_per_order, 1) OVER ({W})"),
          ("freight_prev_day", f"lag(total_freight, 1) OVER ({W})"),
          ("avg_freight_prev_day", f"lag(avg_freight, 1) OVER ({W})"),
          ("sellers_prev_day", f"lag(total_sellers, 1) OVER ({W})"),
          ("sellers_roll_mean_7", _full(7, "avg(total_sellers)")),
          ("rev_per_seller_prev_day", f"lag(daily_revenue / greatest(total_sellers, 1.0), 1) OVER ({W})"),
          ("time_index", f"CAST(datediff('day', min({d}) OVER (PARTITION BY series_key), {d}) AS INTEGER)")]
    return f


def _feat_ctes() -> str:
    cols = ",\n       ".join(f"{e} AS {n}" for n, e in feature_select())
    return _series_ctes() + f""",
feat AS (SELECT *, {cols} FROM tsc)"""


def _r(name: str) -> str:
    return f"round({name}, {R}) AS {name}" if noisy(name) and name not in INT_FEATURES else name


def tsql(body: str, by: str | None = None, with_features: bool = False):
    return lambda p: with_base(body, p, (_feat_ctes() if with_features else _series_ctes(by)) + _split_ctes(p))


def _split_ctes(p: Params) -> str:
    return f""",
split_of AS (SELECT CASE WHEN d <= DATE '{p.train_end}' THEN 'train'
                         WHEN d BETWEEN DATE '{p.valid_start}' AND DATE '{p.valid_end}' THEN 'valid'
                         WHEN d >= DATE '{p.test_start}' THEN 'test' END AS split, d
             FROM (SELECT DISTINCT order_date AS d FROM ts) x)"""


# --- H1-H4 -------------------------------------------------------------------------------------
DAILY_COLS = "series_key, order_date, " + ", ".join(T.MEASURES)


@register("h1_daily_aggregates", tsql(f"SELECT {DAILY_COLS} FROM dd"))
def h1(ctx):
    return T.daily_aggregates(ctx.fact, single=ctx.single_orders)


@register("h1_daily_aggregates_by_state", tsql(f"SELECT {DAILY_COLS} FROM dd", by="state_code"))
def h1s(ctx):
    return T.daily_aggregates(ctx.fact, "state_code", ctx.single_orders)


@register("h2_h3_gap_filled_series", tsql("""
SELECT series_key, order_date, total_orders, total_items, total_customers, total_sellers, daily_revenue,
       avg_item_price, total_freight, avg_freight, avg_items_per_order,
       avg_order_value, round(log_daily_revenue, 6) AS log_daily_revenue FROM ts"""))
def h2(ctx):
    return rounded(series(ctx))


@register("h2_h3_gap_filled_by_category", tsql("""
SELECT series_key, count(*) AS days, min(order_date) AS first_day, max(order_date) AS last_day,
       CAST(sum(total_orders) AS DOUBLE) AS total_orders FROM ts GROUP BY 1""", by="product_category_name_english"))
def h2c(ctx):
    s = series(ctx, "product_category_name_english")
    return s.groupBy("series_key").agg(F.count(F.lit(1)).cast("long").alias("days"),
                                       F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"),
                                       F.sum("total_orders").alias("total_orders"))


@register("h4_data_cutoff", tsql("SELECT series_key, cutoff_date FROM cut"))
def h4(ctx):
    return T.data_cutoff(series(ctx))


@register("h4_data_cutoff_by_state", tsql("SELECT series_key, cutoff_date FROM cut", by="state_code"))
def h4s(ctx):
    return T.data_cutoff(series(ctx, "state_code"))


# --- H5-H13 ------------------------------------------------------------------------------------
def _feature_query(names: list[str], key: str):
    sql_cols = ", ".join(_r(n) for n in names)

    @register(key, tsql(f"SELECT series_key, order_date, {sql_cols} FROM feat", with_features=True))
    def _q(ctx):
        return rounded(features(ctx).select("series_key", "order_date", *names))
    return _q


ALL_FEATURES = [n for n, _ in feature_select()]
_feature_query([n for n in ALL_FEATURES[:12]], "h5_calendar_features")
_feature_query(["day_sin", "day_cos", "month_sin", "month_cos"], "h6_cyclic_features")
_feature_query(["black_friday_week", "christmas_season", "new_year_day", "mothers_day", "fathers_day"],
               "h7_event_flags")
_feature_query([n for n in ALL_FEATURES if n.startswith("fourier_")], "h8_fourier_terms")
_feature_query([n for n in ALL_FEATURES if "_lag_" in n], "h9_lag_features")
_feature_query([n for n in ALL_FEATURES if "_roll_" in n and "ema" not in n], "h10_rolling_stats")
_feature_query([n for n in ALL_FEATURES if "ema" in n], "h11_ewm_mean")
_feature_query(["orders_prev_day", "aov_prev_day", "customers_prev_day", "items_prev_day",
                "items_per_order_prev_day", "freight_prev_day", "avg_freight_prev_day", "sellers_prev_day",
                "sellers_roll_mean_7", "rev_per_seller_prev_day"], "h12_prev_day_drivers")
_feature_query(["time_index"], "h13_time_index")

_NOT_NULL = " AND ".join(f"{n} IS NOT NULL" for n in ALL_FEATURES)


@register("h14_model_ready", tsql(f"""
SELECT series_key, count(*) AS rows, min(order_date) AS first_day, max(order_date) AS last_day,
       CAST({len([n for n in ALL_FEATURES if n not in T.EXCLUDED])} AS INTEGER) AS n_features
FROM feat WHERE {_NOT_NULL} GROUP BY 1""", with_features=True))
def h14(ctx):
    r = ready(ctx)
    return r.groupBy("series_key").agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                       F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day")) \
            .withColumn("n_features", F.lit(len(T.feature_columns(r))).cast("int"))


@register("h15_temporal_split", tsql(f"""
SELECT series_key, max(CASE WHEN s.split = 'train' THEN order_date END) AS train_end,
       min(CASE WHEN s.split = 'valid' THEN order_date END) AS valid_start,
       min(CASE WHEN s.split = 'test' THEN order_date END) AS test_start,
       count(*) FILTER (WHERE s.split = 'train') AS train_rows, count(*) FILTER (WHERE s.split = 'valid') AS valid_rows,
       count(*) FILTER (WHERE s.split = 'test') AS test_rows,
       max(CASE WHEN s.split = 'train' THEN order_date END) < min(CASE WHEN s.split = 'valid' THEN order_date END)
         AND min(CASE WHEN s.split = 'valid' THEN order_date END) < min(CASE WHEN s.split = 'test' THEN order_date END)
         AS no_leakage
FROM feat f JOIN split_of s ON f.order_date = s.d WHERE {_NOT_NULL} GROUP BY 1""", with_features=True))
def h15(ctx):
    return T.leakage_check(T.temporal_split(ready(ctx), ctx.params))


# --- H16 / H17 / H22 / H25 / H26 / H29 / H30 -------------------------------------------------------------
BASE_CTE = f"""
, bl AS (SELECT f.series_key, f.order_date, f.daily_revenue AS y, s.split,
                lag(daily_revenue, 1) OVER ({W}) AS pred_naive,
                exp({_full(7, "avg(log_daily_revenue)")}) - 1 AS pred_ma7_log,
                {_full(7, "avg(daily_revenue)")} AS pred_ma7_raw
         FROM feat f JOIN split_of s ON f.order_date = s.d),
lp AS (SELECT series_key, order_date, 'naive' AS model, y, pred_naive AS pred, split FROM bl
       UNION ALL SELECT series_key, order_date, 'ma7', y, pred_ma7_log, split FROM bl)"""


def bsql(body: str):
    return lambda p: with_base(body, p, _feat_ctes() + _split_ctes(p) + BASE_CTE)


@register("h16_baselines", bsql("""
SELECT series_key, order_date, y AS daily_revenue, pred_naive,
       round(pred_ma7_log, 6) AS pred_ma7_log, round(pred_ma7_raw, 6) AS pred_ma7_raw FROM bl"""))
def h16(ctx):
    b = with_baselines(ctx)
    return rounded(b.select("series_key", "order_date", "daily_revenue", "pred_naive", "pred_ma7_log", "pred_ma7_raw"))


METRICS_SQL = """
SELECT series_key, model, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae,
       round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
       round(1.0 - sum((y - pred) * (y - pred)) / sum((y - my) * (y - my)), 6) AS r2,
       round(avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END) * 100.0, 6) AS mape
FROM (SELECT *, avg(y) OVER (PARTITION BY series_key, model) AS my FROM lp WHERE split = 'test' AND pred IS NOT NULL) t
GROUP BY 1, 2"""


@register("h17_regression_metrics", bsql(METRICS_SQL))
def h17(ctx):
    p = baseline_preds(ctx).where("split = 'test'")
    return rounded(T.regression_metrics(p), cols=["mae", "rmse", "r2", "mape"])


@register("h22_diebold_mariano", bsql("""
SELECT series_key, n, round(CASE WHEN ok THEN dm ELSE 0.0 END, 6) AS dm_stat,
       round(CASE WHEN ok THEN (CASE WHEN dm >= 0 THEN 1.0 - up ELSE up END) ELSE 1.0 END, 6) AS p_value
FROM (SELECT *, exp(-abs(dm) * abs(dm) / 2.0) / sqrt(2 * pi()) *
               (tt * (0.319381530 + tt * (-0.356563782 + tt * (1.781477937 + tt * (-1.821255978 + tt * 1.330274429)))))
               AS up
      FROM (SELECT *, 1.0 / (1.0 + 0.2316419 * abs(dm)) AS tt
            FROM (SELECT series_key, n, n >= 2 AND var_d IS NOT NULL AND var_d > 0 AS ok,
                         CASE WHEN n >= 2 AND var_d > 0 THEN mean_d / sqrt(var_d / n) * sqrt((n - 1) / (n - 1)) END AS dm
                  FROM (SELECT series_key, count(*) AS n, avg(d) AS mean_d, var_samp(d) AS var_d
                        FROM (SELECT series_key, pow(y - pred_ma7_log, 2) - pow(y - pred_naive, 2) AS d FROM bl
                              WHERE split = 'test' AND pred_ma7_log IS NOT NULL AND pred_naive IS NOT NULL) x
                        GROUP BY 1) a) b) c) e"""))
def h22(ctx):
    b = with_baselines(ctx).where("split = 'test'").select(
        "series_key", (F.col("daily_revenue") - F.col("pred_ma7_log")).alias("e_ma7"),
        (F.col("daily_revenue") - F.col("pred_naive")).alias("e_naive"))
    return rounded(T.diebold_mariano(b, "e_ma7", "e_naive"), cols=["dm_stat", "p_value"])


INTERVAL_CTE = """
, sd AS (SELECT series_key, model, stddev_pop(y - pred) AS resid_std FROM lp
         WHERE split = 'valid' AND pred IS NOT NULL GROUP BY 1, 2),
iv AS (SELECT lp.*, sd.resid_std, greatest(pred - 1.96 * resid_std, 0.0) AS lower, pred + 1.96 * resid_std AS upper
       FROM lp JOIN sd ON lp.series_key = sd.series_key AND lp.model = sd.model WHERE split = 'test')"""


def isql(body: str):
    return lambda p: with_base(body, p, _feat_ctes() + _split_ctes(p) + BASE_CTE + INTERVAL_CTE)


def _intervals(ctx):
    p = baseline_preds(ctx)
    return T.residual_interval(p.where("split = 'valid'"), p.where("split = 'test'"))


@register("h25_residual_interval", isql("""
SELECT series_key, model, order_date, round(y, 6) AS y, round(pred, 6) AS pred, round(lower, 6) AS lower,
       round(upper, 6) AS upper FROM iv"""))
def h25(ctx):
    return rounded(_intervals(ctx).select("series_key", "model", "order_date", "y", "pred", "lower", "upper"),
                   cols=["y", "pred", "lower", "upper"])


@register("h26_interval_coverage", isql("""
SELECT series_key, model, count(*) AS n, round(avg(CAST(y >= lower AND y <= upper AS DOUBLE)), 6) AS coverage
FROM iv WHERE pred IS NOT NULL GROUP BY 1, 2"""))
def h26(ctx):
    return rounded(T.interval_coverage(_intervals(ctx)), cols=["coverage"])


ERR_CTE = """
, er AS (SELECT series_key, model, order_date, y, pred, y - pred AS residual, abs(y - pred) AS abs_error,
                abs(y - pred) / greatest(abs(y), 1.0) * 100.0 AS pct_error
         FROM lp WHERE split = 'test' AND pred IS NOT NULL)"""


@register("h29_worst_days", lambda p: with_base("""
SELECT series_key, model, order_date, round(y, 6) AS y, round(pred, 6) AS pred, round(residual, 6) AS residual,
       round(abs_error, 6) AS abs_error, round(pct_error, 6) AS pct_error
FROM (SELECT *, row_number() OVER (PARTITION BY series_key, model ORDER BY abs_error DESC, order_date) AS r FROM er) t
WHERE r <= 5""", p, _feat_ctes() + _split_ctes(p) + BASE_CTE + ERR_CTE))
def h29(ctx):
    return rounded(T.worst_days(T.error_table(baseline_preds(ctx).where("split = 'test'"))),
                   cols=["y", "pred", "residual", "abs_error", "pct_error"])


@register("h30_monthly_error", lambda p: with_base("""
SELECT series_key, model, strftime(order_date, '%Y-%m') AS month, round(avg(abs_error), 6) AS mae,
       round(sqrt(avg(residual * residual)), 6) AS rmse, count(*) AS days FROM er GROUP BY 1, 2, 3""",
                                                      p, _feat_ctes() + _split_ctes(p) + BASE_CTE + ERR_CTE))
def h30(ctx):
    return rounded(T.monthly_error(T.error_table(baseline_preds(ctx).where("split = 'test'"))),
                   cols=["mae", "rmse"])


@register("h31_monthly_rollups", isql("""
SELECT series_key, strftime(order_date, '%Y-%m') AS month, round(sum(pred), 6) AS pred, round(sum(lower), 6) AS lower,
       round(sum(upper), 6) AS upper FROM iv WHERE model = 'naive' GROUP BY 1, 2"""))
def h31(ctx):
    iv = _intervals(ctx).where("model = 'naive'")
    return rounded(T.monthly_rollup(iv, ["pred", "lower", "upper"]), cols=["pred", "lower", "upper"])


@register("h32_history_forecast_merge", isql("""
SELECT COALESCE(h.series_key, f.series_key) AS series_key, COALESCE(h.month, f.month) AS month,
       round(h.actual, 6) AS actual, round(f.forecast, 6) AS forecast, round(f.lower, 6) AS lower,
       round(f.upper, 6) AS upper
FROM (SELECT series_key, strftime(order_date, '%Y-%m') AS month, sum(daily_revenue) / 1000.0 AS actual
      FROM tsc GROUP BY 1, 2) h
FULL OUTER JOIN (SELECT series_key, strftime(order_date, '%Y-%m') AS month, sum(pred) / 1000.0 AS forecast,
                        sum(lower) / 1000.0 AS lower, sum(upper) / 1000.0 AS upper
                 FROM iv WHERE model = 'naive' GROUP BY 1, 2) f
  ON h.series_key = f.series_key AND h.month = f.month"""))
def h32(ctx):
    hist = T.monthly_rollup(T.apply_cutoff(series(ctx)), ["daily_revenue"])
    fc = T.monthly_rollup(_intervals(ctx).where("model = 'naive'"), ["pred", "lower", "upper"])
    m = T.merge_history_forecast(hist, fc, scale=1000.0)
    return rounded(m.select("series_key", "month", "actual", "forecast", "lower", "upper"),
                   cols=["actual", "forecast", "lower", "upper"])


# --- H33 / H34 -----------------------------------------------------------------------------------------
MODEL_FEATURES = [n for n in ALL_FEATURES if n not in T.EXCLUDED]
DRIFT_FEATURES = [n for n in MODEL_FEATURES if n not in T.CALENDAR_ONLY and not n.startswith("fourier_")]


def _stack_sql(src: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT series_key, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {src}"
                              for c in cols)


def _drift_ctes(p: Params) -> str:
    return _feat_ctes() + _split_ctes(p) + f""",
rd AS (SELECT f.* FROM feat f JOIN split_of s ON f.order_date = s.d WHERE {_NOT_NULL} AND s.split = 'train'),
st AS (SELECT series_key, feature, avg(v) AS mean, stddev_samp(v) AS std FROM ({_stack_sql('rd', MODEL_FEATURES)}) x
       GROUP BY 1, 2),
rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY order_date DESC) AS r0
                      FROM feat WHERE {_NOT_NULL}) q WHERE r0 <= {T.DRIFT_RECENT_WINDOW}),
rs AS (SELECT series_key, feature, avg(v) AS recent_mean, stddev_samp(v) AS recent_std
       FROM ({_stack_sql('rc', DRIFT_FEATURES)}) x GROUP BY 1, 2),
dz AS (SELECT rs.*, st.mean AS train_mean, st.std AS train_std,
              round((recent_mean - st.mean) / CASE WHEN COALESCE(st.std, 0.0) > 0 THEN st.std
                                                   WHEN abs(st.mean) * 0.01 <> 0 THEN abs(st.mean) * 0.01
                                                   ELSE 1.0 END, 2) AS z_score
       FROM rs JOIN st ON rs.series_key = st.series_key AND rs.feature = st.feature)"""


def _train_stats(ctx):
    r = T.temporal_split(ready(ctx), ctx.params).where("split = 'train'")
    return T.feature_stats(r, T.feature_columns(ready(ctx)))


@register("h33_feature_stats", lambda p: with_base(
    "SELECT series_key, feature, round(mean, 4) AS mean, round(std, 4) AS std FROM st", p, _drift_ctes(p)))
def h33(ctx):
    return _train_stats(ctx).select("series_key", "feature", F.round("mean", 4).alias("mean"),
                                    F.round("std", 4).alias("std"))


def _drift(ctx):
    return T.drift_features(ready(ctx), _train_stats(ctx), T.feature_columns(ready(ctx)))


@register("h34_drift_report", lambda p: with_base("""
SELECT series_key, feature, round(recent_mean, 4) AS recent_mean, round(train_mean, 4) AS train_mean, z_score
FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY abs(z_score) DESC, feature) AS r FROM dz) t
WHERE r <= 10""", p, _drift_ctes(p)))
def h34(ctx):
    return T.top_drift(_drift(ctx)).select("series_key", "feature", F.round("recent_mean", 4).alias("recent_mean"),
                                           F.round("train_mean", 4).alias("train_mean"), "z_score")


@register("h34_drift_status", lambda p: with_base(f"""
SELECT series_key, n_features, n_watch, n_drifted, score,
       CASE WHEN n_drifted / n_features >= 0.15 OR n_watch / n_features >= 0.40 THEN 'drifted'
            WHEN n_watch / n_features >= 0.10 THEN 'watch' ELSE 'healthy' END AS status
FROM (SELECT series_key, count(*) AS n_features, count(*) FILTER (WHERE abs(z_score) >= {T.Z_WATCH}) AS n_watch,
             count(*) FILTER (WHERE abs(z_score) >= {T.Z_DRIFT}) AS n_drifted,
             COALESCE(max(abs(z_score)), 0.0) AS score FROM dz GROUP BY 1) t""", p, _drift_ctes(p)))
def h34s(ctx):
    return T.drift_summary(_drift(ctx)).withColumn("score", F.col("score").cast("double"))


# --- model-dependent (rows check) ----------------------------------------------------------------------
def _prepared(ctx):
    return ctx.memo("prepared", lambda: FC.prepared(ready(ctx), ctx.params))


def _searched(ctx):
    def build():
        data, _ = _prepared(ctx)
        return {name: FC.param_search(data, name, grid) for name, grid in FC.FAMILIES.items()}
    return ctx.memo("fits", build)


def _best(ctx):
    """The best trial of each family."""
    return FC.best_of_family([f for fits in _searched(ctx).values() for f in fits])


def _predictions(ctx):
    """The stored predictions that weights, blend and champion are taken from."""
    data, _ = _prepared(ctx)
    return ctx.memo("predictions", lambda: ctx._store(FC.prediction_table(_best(ctx), data), "forecast_predictions"))


def _weights(ctx):
    return ctx.memo("weights", lambda: ctx._store(FC.blend_weights(_predictions(ctx)), "forecast_weights"))


def _deployed(ctx):
    """The champion of H21 fitted on all complete days."""
    def build():
        data, _ = _prepared(ctx)
        choice = FC.champion(_predictions(ctx), _weights(ctx)).first()["champion"]
        return FC.deployed(data, _best(ctx), choice, _weights(ctx))
    return ctx.memo("deployed", build)


@register("h18_regressor_fit")
def h18(ctx):
    data, _ = _prepared(ctx)
    best = _searched(ctx)["random_forest"][0]
    return FC.predict(best.model, data.where("split = 'test'"), "random_forest")


@register("h19_param_search")
def h19(ctx):
    fits = _searched(ctx)
    return FC.search_table(ctx.spark, [f for family in fits.values() for f in family])


@register("h20_weighted_ensemble")
def h20(ctx):
    return FC.blend(_predictions(ctx), _weights(ctx)).where("split = 'test'").drop("split")


@register("h20_family_weights")
def h20w(ctx):
    return _weights(ctx)


@register("h21_champion")
def h21(ctx):
    return FC.champion(_predictions(ctx), _weights(ctx))


# the same operators over a prediction table of rules: naive, the two 7-day means and the day a week ago
RULE_CTE = f"""
, pt AS (
  SELECT m.model, bl.split, bl.series_key, bl.order_date, bl.y,
         ln(1 + CASE m.model WHEN 'naive' THEN pred_naive WHEN 'ma7_log' THEN pred_ma7_log WHEN 'ma7_raw' THEN pred_ma7_raw
                             ELSE pred_week END) AS pred_log
  FROM (SELECT bl.*, lag(y, 7) OVER ({W}) AS pred_week FROM bl) bl,
       (SELECT unnest(['naive', 'ma7_log', 'ma7_raw', 'week']) AS model) m
  WHERE split IN ('valid', 'test')),
wt AS (
  SELECT model, valid_rmse, rank, (1 / valid_rmse) / sum(1 / valid_rmse) OVER () AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY valid_rmse, model) AS rank
        FROM (SELECT model, sqrt(avg(pow(y - (exp(pred_log) - 1), 2))) AS valid_rmse FROM pt
              WHERE split = 'valid' AND pred_log IS NOT NULL GROUP BY 1) r) q WHERE rank <= {FC.BLEND_TOP}),
en AS (
  SELECT split, series_key, order_date, max(y) AS y, sum(weight * pred_log) AS pred_log
  FROM pt JOIN wt USING (model) WHERE pred_log IS NOT NULL GROUP BY 1, 2, 3
  HAVING count(*) = (SELECT count(*) FROM wt))"""


def _rule_predictions(ctx):
    b = with_baselines(ctx)
    b = b.withColumn("pred_week", F.lag("daily_revenue", 7).over(T.series_window()))
    models = {"naive": "pred_naive", "ma7_log": "pred_ma7_log", "ma7_raw": "pred_ma7_raw", "week": "pred_week"}
    stacked = b.select("split", "series_key", "order_date", F.col("daily_revenue").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.log1p(c).alias("pred_log")) for m, c in models.items()])).alias("s"))
    return (stacked.where(F.col("split").isin("valid", "test"))
            .select("s.model", "split", "series_key", "order_date", "y", "s.pred_log"))


def rsql(body: str):
    return lambda p: with_base(body, p, _feat_ctes() + _split_ctes(p) + BASE_CTE + RULE_CTE)


@register("h20_blend_weights_of_rules", rsql("""
SELECT model, round(valid_rmse, 4) AS valid_rmse, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM wt"""))
def h20rw(ctx):
    w = FC.blend_weights(_rule_predictions(ctx))
    return rounded(rounded(w, 4, ["valid_rmse"]), cols=["weight"])


@register("h20_blend_of_rules", rsql("""
SELECT split, series_key, order_date, round(y, 2) AS y, round(pred_log, 6) AS pred_log FROM en"""))
def h20rb(ctx):
    preds = _rule_predictions(ctx)
    out = FC.blend(preds, FC.blend_weights(preds)).select("split", "series_key", "order_date", "y", "pred_log")
    return rounded(rounded(out, 2, ["y"]), cols=["pred_log"])


def _champion_sql(threshold: float) -> str:
    return f"""
SELECT best_single, round(best_single_rmse, 4) AS best_single_rmse, round(ensemble_rmse, 4) AS ensemble_rmse,
       round(1 - ensemble_rmse / best_single_rmse, 6) AS gain,
       CASE WHEN 1 - ensemble_rmse / best_single_rmse >= {threshold} THEN 'ensemble' ELSE best_single END AS champion
FROM (SELECT model AS best_single, valid_rmse AS best_single_rmse FROM wt WHERE rank = 1) a,
     (SELECT sqrt(avg(pow(y - (exp(pred_log) - 1), 2))) AS ensemble_rmse FROM en WHERE split = 'valid') b"""


def _rule_champion(ctx, threshold: float):
    preds = _rule_predictions(ctx)
    c = FC.champion(preds, FC.blend_weights(preds), threshold)
    return rounded(rounded(c, 4, ["best_single_rmse", "ensemble_rmse"]), cols=["gain"])


@register("h21_champion_of_rules", rsql(_champion_sql(FC.PROMOTE_THRESHOLD)))
def h21r(ctx):
    return _rule_champion(ctx, FC.PROMOTE_THRESHOLD)


@register("h21_champion_of_rules_other_side", rsql(_champion_sql(-1.0)))
def h21r2(ctx):
    """A threshold that every blend passes."""
    return _rule_champion(ctx, -1.0)


@register("h23_walk_forward_backtest")
def h23(ctx):
    data, _ = _prepared(ctx)
    best = _searched(ctx)["random_forest"][0]
    return FC.walk_forward(data, FC.fitted_per_fold("random_forest", best.params))


@register("h24_expanding_window_cv")
def h24(ctx):
    data, _ = _prepared(ctx)
    best = _searched(ctx)["random_forest"][0]
    return FC.expanding_cv(data, FC.fitted_per_fold("random_forest", best.params))


# the same folds scored by a rule that needs no fit: the 7-day mean
def _rule_days(ctx):
    b = T.baselines(features(ctx)).where(F.col("pred_ma7_log").isNotNull())
    return b.select("series_key", "order_date", F.lit("ma7").alias("model"), F.col("daily_revenue").alias("y"),
                    F.col("pred_ma7_log").alias("pred"))


def _fold_metrics(of: str) -> str:
    return f"""count(*) AS n, round(avg(abs(y - pred)), 4) AS mae, round(sqrt(avg(pow(y - pred, 2))), 4) AS rmse,
       round(1.0 - sum(pow(y - pred, 2)) / nullif(var_pop(y) * count(*), 0), 6) AS r2,
       round(avg(CASE WHEN y <> 0 THEN abs((y - pred) / y) END) * 100.0, 6) AS mape FROM {of}"""


_DAYS_CTE = ", dy AS (SELECT order_date, y, pred_ma7_log AS pred FROM bl WHERE pred_ma7_log IS NOT NULL)"


def _rounded_folds(df):
    return rounded(rounded(df, 4, ["mae", "rmse"]), cols=["r2", "mape"])


@register("h23_walk_forward_of_a_rule", bsql(_DAYS_CTE + f"""
, fo AS (SELECT k AS fold, CAST(m + CAST((k - 4) * 30 AS INTEGER) AS DATE) AS s, least(CAST(m + CAST((k - 4) * 30 + 29 AS INTEGER) AS DATE), m) AS e
         FROM (SELECT max(order_date) AS m FROM dy) z, (SELECT unnest(range(1, 5)) AS k) q)
SELECT CAST(fold AS INTEGER) AS fold, strftime(s, '%Y-%m-%d') AS fold_test_start, strftime(e, '%Y-%m-%d') AS fold_test_end,
       'ok' AS status, {_fold_metrics("dy JOIN fo ON order_date BETWEEN s AND e")} GROUP BY 1, 2, 3"""))
def h23r(ctx):
    return _rounded_folds(FC.walk_forward(_rule_days(ctx), lambda train, test: test))


@register("h23_walk_forward_without_enough_days", bsql(_DAYS_CTE + """
SELECT CAST(k AS INTEGER) AS fold, strftime(CAST(m + CAST((k - 4) * 30 AS INTEGER) AS DATE), '%Y-%m-%d') AS fold_test_start,
       strftime(least(CAST(m + CAST((k - 4) * 30 + 29 AS INTEGER) AS DATE), m), '%Y-%m-%d') AS fold_test_end, 'short_train' AS status,
       CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse, CAST(NULL AS DOUBLE) AS r2,
       CAST(NULL AS DOUBLE) AS mape
FROM (SELECT max(order_date) AS m FROM dy) z, (SELECT unnest(range(1, 5)) AS k) q"""))
def h23s(ctx):
    """More days of training asked for than there are."""
    return FC.walk_forward(_rule_days(ctx), lambda train, test: test, min_train=10 ** 6)


@register("h24_expanding_cv_of_a_rule", bsql(_DAYS_CTE + f"""
, nd AS (SELECT dy.*, row_number() OVER (ORDER BY order_date) - 1 AS i, count(*) OVER () AS n0, (count(*) OVER ()) // 6 AS size FROM dy),
fo AS (SELECT k AS fold, n0 - (5 - (k - 1)) * size AS lo, size FROM (SELECT DISTINCT n0, size FROM nd) z, (SELECT unnest(range(1, 6)) AS k) q)
SELECT CAST(fold AS INTEGER) AS fold, CAST(lo AS BIGINT) AS train_size,
       {_fold_metrics("nd JOIN fo ON i >= lo AND i < lo + fo.size")} GROUP BY 1, 2"""))
def h24r(ctx):
    return _rounded_folds(FC.expanding_cv(_rule_days(ctx), lambda train, test: test))


@register("h27_recursive_forecast")
def h27(ctx):
    _, cols = _prepared(ctx)
    return FC.recursive_forecast(T.apply_cutoff(series(ctx)), _deployed(ctx), cols)


@register("h28_feature_importance")
def h28(ctx):
    """Of the deployed champion, over the test days."""
    data, cols = _prepared(ctx)
    rows = FC.arrayed(data.where("split = 'test'").drop("features", "label"), cols)
    return FC.permutation_importance(rows, cols, ["series_key", "order_date"], FC.scorer(_deployed(ctx)))


# the same operator for a rule: the day's revenue from its items and their mean price, and three features of no effect
RULE_FEATURES = ["total_items", "log_rev_lag_7", "avg_item_price", "day_of_week", "time_index"]
RULE_WEIGHTS, RULE_BASE = [0.04, 0.0, 2.6e-5, 0.0, 0.0], 11.8


def _permuted_sql(j: int) -> str:
    terms = f"{RULE_BASE} + " + " + ".join(f"CAST({w!r} AS DOUBLE) * CAST({'o' if i == j else 'k'}.{c} AS DOUBLE)"
                       for i, (c, w) in enumerate(zip(RULE_FEATURES, RULE_WEIGHTS)))
    return f"""
SELECT '{RULE_FEATURES[j]}' AS feature, avg(e - base) AS rise FROM (
  SELECT r, avg(pow(k.label - ({terms}), 2)) AS e
  FROM rk k, (SELECT unnest(range(1, 6)) AS r) rr, nn, rk o
  WHERE o.i = (k.i - 1 + 1 + (r * 7919) % (nn.n - 1)) % nn.n + 1 GROUP BY r) t, bs"""


@register("h28_permutation_of_a_rule", tsql(f"""
, rk AS (SELECT *, log_daily_revenue AS label,
                row_number() OVER (ORDER BY md5('{FC.SEED}:' || series_key || ':' || strftime(order_date, '%Y-%m-%d'))) AS i
         FROM feat f JOIN split_of s ON f.order_date = s.d WHERE {_NOT_NULL} AND s.split = 'test'),
nn AS (SELECT count(*) AS n FROM rk),
bs AS (SELECT avg(pow(label - ({RULE_BASE} + {" + ".join(f"CAST({w!r} AS DOUBLE) * CAST({c} AS DOUBLE)"
                                                         for c, w in zip(RULE_FEATURES, RULE_WEIGHTS))}), 2)) AS base FROM rk),
im AS ({" UNION ALL ".join(_permuted_sql(j) for j in range(len(RULE_FEATURES)))})
SELECT feature, round(rise, 6) AS rise,
       round(CASE WHEN sum(greatest(rise, 0)) OVER () > 0 THEN greatest(rise, 0) / sum(greatest(rise, 0)) OVER () * 100.0 ELSE 0.0 END, 4)
         AS importance FROM im""", with_features=True))
def h28r(ctx):
    rows = FC.arrayed(T.temporal_split(ready(ctx), ctx.params).where("split = 'test'"), RULE_FEATURES)

    def rule(df):
        return df.withColumn("prediction", reduce(lambda a, b: a + b, [
            F.lit(RULE_BASE), *[F.get("x", F.lit(i)) * w for i, w in enumerate(RULE_WEIGHTS)]]))

    out = FC.permutation_importance(rows, RULE_FEATURES, ["series_key", "order_date"], rule)
    return rounded(rounded(out, cols=["rise"]), 4, ["importance"])
