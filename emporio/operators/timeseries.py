"""Daily revenue series, features, baselines, evaluation, drift.

Every operator runs per ``series_key`` -- the reference's single
company-wide series is the constant key 'all'; keys by state, category or
seller give thousands of independent series.  Series windows are
``Window.partitionBy("series_key").orderBy("order_date")``: one series
lives in one task, and a series has one row per calendar day, so its
size is bounded by the date range, not by the fact table (the fact is
reduced to daily grain by an ordinary partial/final aggregation first).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..functions.order_rows import order_rows

# Fixed values of the forecasting recipe.
LAG_DAYS = [1, 2, 3, 7, 14, 28, 30, 60, 90]
ROLLING_WINDOWS = [7, 14, 30, 60, 90]
CUTOFF_SELLER_RATIO = 0.5
CUTOFF_TRAIL_WINDOW = 90
FORECAST_HORIZON = 30
DRIFT_RECENT_WINDOW = 60
Z_WATCH, Z_DRIFT = 2.0, 3.0
EXCLUDED = ["order_date", "log_daily_revenue", "daily_revenue", "rev_lag_1", "total_orders", "total_items",
            "total_customers", "total_sellers", "avg_item_price", "total_freight", "avg_freight",
            "avg_items_per_order", "avg_order_value"]
CALENDAR_ONLY = {"year", "quarter", "month", "week_of_year", "day_of_month", "day_of_week", "day_of_year",
                 "weekend_flag", "month_start", "month_end", "quarter_start", "quarter_end", "day_sin",
                 "day_cos", "month_sin", "month_cos", "black_friday_week", "christmas_season",
                 "new_year_day", "mothers_day", "fathers_day", "time_index"}

MEASURES = ["total_orders", "total_items", "total_customers", "total_sellers", "daily_revenue",
            "avg_item_price", "total_freight", "avg_freight"]


def series_window() -> Window:
    return Window.partitionBy("series_key").orderBy("order_date")


# --- H1 / H2 / H3 ----------------------------------------------------------------------------
def daily_aggregates(fact: DataFrame, series_col: str | None = None, single: bool = False) -> DataFrame:
    """Day (per series) -> orders, items, customers, sellers, revenue, averages (DOUBLE); ``single`` as in ``order_rows``."""
    key = F.col(series_col).cast("string") if series_col else F.lit("all")
    f = fact.select(key.alias("series_key"), "order_date", "order_id", "customer_id", "seller_id",
                    "price", "freight_value", "total_sales_amount")
    day = ["series_key", "order_date"]
    sums = {"_revenue": "total_sales_amount", "_price": "price", "_freight": "freight_value"}
    # orders first: their count is a row count then, and one distinct count is left
    by_order = order_rows(f, [*day, "order_id"], ["customer_id"], {
        "_items": F.count(F.lit(1)), "_prices": F.count("price"), "_freights": F.count("freight_value"),
        **{n: F.sum(c) for n, c in sums.items()}}, single)
    sellers = (f.where(F.col("seller_id").isNotNull()).select(*day, "seller_id").distinct()
               .groupBy(*day).agg(F.count(F.lit(1)).alias("_sellers")))
    days = by_order.groupBy(*day).agg(
        F.count("order_id").alias("_orders"), F.countDistinct("customer_id").alias("_customers"),
        *[F.sum(c).alias(c) for c in ("_items", "_prices", "_freights", *sums)])
    return days.join(sellers, day, "left").select(
        *day, F.col("_orders").cast("double").alias("total_orders"), F.col("_items").cast("double").alias("total_items"),
        F.col("_customers").cast("double").alias("total_customers"),
        F.coalesce("_sellers", F.lit(0)).cast("double").alias("total_sellers"),
        F.col("_revenue").cast("double").alias("daily_revenue"),
        (F.col("_price").cast("double") / F.nullif(F.col("_prices"), F.lit(0))).alias("avg_item_price"),
        F.col("_freight").cast("double").alias("total_freight"),
        (F.col("_freight").cast("double") / F.nullif(F.col("_freights"), F.lit(0))).alias("avg_freight"))


def gap_fill(daily: DataFrame) -> DataFrame:
    """H2: one row per day between each series' first and last day; missing -> 0."""
    bounds = daily.groupBy("series_key").agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    grid = bounds.select("series_key", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY")))
                         .alias("order_date"))
    return grid.join(daily, ["series_key", "order_date"], "left").fillna(0.0, subset=MEASURES)


def add_drivers(ts: DataFrame) -> DataFrame:
    """H3: items/order, revenue/order (orders clipped at >= 1), log1p revenue."""
    orders = F.greatest(F.col("total_orders"), F.lit(1.0))
    return (ts.withColumn("avg_items_per_order", F.col("total_items") / orders)
              .withColumn("avg_order_value", F.col("daily_revenue") / orders)
              .withColumn("log_daily_revenue", F.log1p("daily_revenue")))


def daily_series(fact: DataFrame, series_col: str | None = None, single: bool = False) -> DataFrame:
    return add_drivers(gap_fill(daily_aggregates(fact, series_col, single)))


# --- H4 ------------------------------------------------------------------------------------------
def data_cutoff(ts: DataFrame, ratio: float = CUTOFF_SELLER_RATIO, trail: int = CUTOFF_TRAIL_WINDOW) -> DataFrame:
    """Last complete day per series: last day with sellers >= ratio * mean(sellers of the last
    ``trail`` days); falls back to the last day."""
    rev = Window.partitionBy("series_key").orderBy(F.desc("order_date"))
    t = ts.select("series_key", "order_date", "total_sellers").withColumn("_r", F.row_number().over(rev))
    tail = (t.where(F.col("_r") <= trail).groupBy("series_key")
             .agg((F.sum("total_sellers") / F.count(F.lit(1))).alias("_tail_mean"), F.max("order_date").alias("_last")))
    return (t.join(tail, "series_key")
             .groupBy("series_key")
             .agg(F.max(F.when(F.col("total_sellers") >= F.lit(ratio) * F.col("_tail_mean"), F.col("order_date")))
                  .alias("_ok"), F.max("_last").alias("_last"))
             .select("series_key", F.coalesce("_ok", "_last").alias("cutoff_date")))


def apply_cutoff(ts: DataFrame) -> DataFrame:
    c = data_cutoff(ts)
    return ts.join(c, "series_key").where(F.col("order_date") <= F.col("cutoff_date")).drop("cutoff_date")


# --- H5-H8 ----------------------------------------------------------------------------------------
def calendar_features(df: DataFrame) -> DataFrame:
    d = F.col("order_date")
    dow = (F.weekday(d) + 1)          # 1 = Monday ... 7 = Sunday
    last = F.last_day(d)
    return df.withColumns({
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "week_of_year": F.weekofyear(d),
        "day_of_month": F.dayofmonth(d), "day_of_week": dow, "day_of_year": F.dayofyear(d),
        "weekend_flag": (dow >= 6).cast("int"), "month_start": (F.dayofmonth(d) == 1).cast("int"),
        "month_end": (d == last).cast("int"),
        "quarter_start": (F.month(d).isin(1, 4, 7, 10) & (F.dayofmonth(d) == 1)).cast("int"),
        "quarter_end": (F.month(d).isin(3, 6, 9, 12) & (d == last)).cast("int"),
    })


def cyclic_features(df: DataFrame) -> DataFrame:
    tau = 2 * math.pi
    return df.withColumns({
        "day_sin": F.sin(F.lit(tau) * F.col("day_of_week") / 7.0),
        "day_cos": F.cos(F.lit(tau) * F.col("day_of_week") / 7.0),
        "month_sin": F.sin(F.lit(tau) * F.col("month") / 12.0),
        "month_cos": F.cos(F.lit(tau) * F.col("month") / 12.0),
    })


def event_flags(df: DataFrame) -> DataFrame:
    m, dd, dw = F.col("month"), F.col("day_of_month"), F.col("day_of_week")
    return df.withColumns({
        "black_friday_week": ((m == 11) & dd.between(20, 30)).cast("int"),
        "christmas_season": ((m == 12) & dd.between(18, 25)).cast("int"),
        "new_year_day": ((m == 1) & (dd == 1)).cast("int"),
        "mothers_day": ((m == 5) & dd.between(8, 14) & (dw == 7)).cast("int"),
        "fathers_day": ((m == 8) & dd.between(8, 14) & (dw == 7)).cast("int"),
    })


def fourier_terms(df: DataFrame, k_max: int = 3, period: float = 365.25) -> DataFrame:
    cols = {}
    for k in range(1, k_max + 1):
        a = F.lit(2 * math.pi * k) * F.col("day_of_year") / period
        cols[f"fourier_sin_{k}"] = F.sin(a)
        cols[f"fourier_cos_{k}"] = F.cos(a)
    return df.withColumns(cols)


# --- H9-H13 ---------------------------------------------------------------------------------------
# Names of the lagged columns (prefix, measure) and of yesterday's measures.
LAGGED = {"log_rev": "log_daily_revenue", "rev": "daily_revenue", "orders": "total_orders",
          "customers": "total_customers", "aov": "avg_order_value"}
YESTERDAY = {"orders": "total_orders", "aov": "avg_order_value", "customers": "total_customers", "items": "total_items",
             "items_per_order": "avg_items_per_order", "freight": "total_freight", "avg_freight": "avg_freight",
             "sellers": "total_sellers"}
SELLER_DAYS = 7


class Past:
    """What a feature may read of the days before: values and statistics of a measure.

    ``WindowPast`` reads them from the rows of the series, the forecast
    from the arrays of its state; the features are stated once.
    """

    def value(self, measure: str, days: int) -> Column:
        raise NotImplementedError

    def stats(self, measure: str, days: int) -> dict[str, Column]:
        """mean, std (sample), min and max of the last ``days`` days, NULL until there are so many."""
        raise NotImplementedError


class WindowPast(Past):
    def value(self, measure, days):
        return F.lag(measure, days).over(series_window())

    def stats(self, measure, days):
        frame = series_window().rowsBetween(-days, -1)
        return {name: _full(frame, days, agg(measure))
                for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))}


def lag_columns(past: Past, lags=LAG_DAYS) -> dict[str, Column]:
    return {f"{prefix}_lag_{days}": past.value(measure, days) for days in lags for prefix, measure in LAGGED.items()}


def lag_features(df: DataFrame, lags=LAG_DAYS) -> DataFrame:
    """H9."""
    return df.withColumns(lag_columns(WindowPast(), lags))


def _full(frame: Window, w: int, agg: Column) -> Column:
    """Aggregate over the previous ``w`` rows, NULL until all ``w`` exist."""
    return F.when(F.count(F.lit(1)).over(frame) == w, agg.over(frame))


def rolling_columns(past: Past, windows=ROLLING_WINDOWS) -> dict[str, Column]:
    cols = {}
    for days in windows:
        of = past.stats("log_daily_revenue", days)
        cols[f"log_rev_roll_mean_{days}"] = of["mean"]
        cols[f"rev_roll_mean_{days}"] = past.stats("daily_revenue", days)["mean"]
        cols |= {f"log_rev_roll_{name}_{days}": of[name] for name in ("std", "min", "max")}
    return cols


def rolling_features(df: DataFrame, windows=ROLLING_WINDOWS) -> DataFrame:
    """Stats of the previous w days (the current day is excluded)."""
    return df.withColumns(rolling_columns(WindowPast(), windows))


def ewm_mean(col: str, span: int) -> Column:
    """Adjusted exponentially weighted mean of all previous days.

    alpha = 2 / (span + 1); weights (1 - alpha)^k for the value k+1 days
    back, normalised by their sum.  No built-in exists: the previous
    values of the series are folded with ``aggregate`` (Horner form).
    O(days^2) per series, bounded by the calendar length.
    """
    r = 1.0 - 2.0 / (span + 1.0)
    hist = F.collect_list(col).over(series_window().rowsBetween(Window.unboundedPreceding, -1))
    folded = F.aggregate(hist, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")),
                         lambda acc, x: F.struct((acc["n"] * r + x).alias("n"), (acc["d"] * r + 1.0).alias("d")),
                         lambda acc: F.when(acc["d"] > 0, acc["n"] / acc["d"]))
    return folded


#: Days of a block of the running weighted sums.
EWM_BLOCK = 32


def ewm_features(df: DataFrame, windows=ROLLING_WINDOWS, method: str = "blocks",
                 col: str = "log_daily_revenue") -> DataFrame:
    """H11 for every span, in built-in expressions.

    ``method="blocks"``: days are cut into blocks; inside one the weighted
    sums are running sums, and what earlier blocks add is folded from one
    number per block, so a series costs O(days) and no row waits for a
    whole history.  ``method="fold"``: the definition over the whole
    history of each day (O(days^2)); both give the same numbers.
    """
    if method == "fold":
        return df.withColumns({f"log_rev_roll_ema_{w}": ewm_mean(col, w) for w in windows})
    day = Window.partitionBy("series_key").orderBy("order_date")
    at = F.row_number().over(day) - 1
    x = F.lag(col).over(day).cast("double")
    rows = (df.withColumns({"_x": x, "_i": at})
            .withColumns({"_b": F.floor(F.col("_i") / EWM_BLOCK), "_p": F.col("_i") % EWM_BLOCK}))
    has = F.col("_x").isNotNull().cast("double")
    decay = {w: 1.0 - 2.0 / (w + 1.0) for w in windows}

    def power(q, exponent):
        return F.pow(F.lit(q), exponent)

    def decayed_by(factor):
        return lambda acc, e: acc * factor + e

    # weighted sums at the end of each block, and what the blocks before leave at its start
    ends = rows.groupBy("series_key", "_b").agg(*[
        F.sum(v * power(q, EWM_BLOCK - 1 - F.col("_p"))).alias(f"_{n}{w}")
        for w, q in decay.items() for n, v in (("n", F.col("_x")), ("d", has))])
    before = Window.partitionBy("series_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("series_key", "_b", *[
        F.aggregate(F.collect_list(F.coalesce(F.col(f"_{n}{w}"), F.lit(0.0))).over(before), F.lit(0.0),
                    decayed_by(q ** EWM_BLOCK)).alias(f"_{n}{w}")
        for w, q in decay.items() for n in "nd"])
    inside = Window.partitionBy("series_key", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carried, ["series_key", "_b"])
    for w, q in decay.items():
        num, den = (power(q, F.col("_p")) * F.coalesce(F.sum(v * power(q, -F.col("_p"))).over(inside), F.lit(0.0))
                    + power(q, F.col("_p") + 1) * F.col(f"_{n}{w}") for n, v in (("n", F.col("_x")), ("d", has)))
        out = out.withColumn(f"log_rev_roll_ema_{w}", F.when(den > 0, num / den))
    return out.select(*df.columns, *[f"log_rev_roll_ema_{w}" for w in windows])


def prev_day_columns(past: Past) -> dict[str, Column]:
    cols = {f"{name}_prev_day": past.value(measure, 1) for name, measure in YESTERDAY.items()}
    cols[f"sellers_roll_mean_{SELLER_DAYS}"] = past.stats("total_sellers", SELLER_DAYS)["mean"]
    sellers = F.greatest(past.value("total_sellers", 1), F.lit(1.0))
    cols["rev_per_seller_prev_day"] = past.value("daily_revenue", 1) / sellers
    return cols


def prev_day_drivers(df: DataFrame) -> DataFrame:
    """yesterday's drivers, 7-day seller mean, revenue per seller."""
    return df.withColumns(prev_day_columns(WindowPast()))


def time_index(df: DataFrame) -> DataFrame:
    """Days since the series' first day (= row index on a gap-free grid)."""
    first = F.min("order_date").over(Window.partitionBy("series_key"))
    return df.withColumn("time_index", F.datediff("order_date", first))


def build_features(ts: DataFrame, with_ewm: bool = True, with_time_index: bool = True) -> DataFrame:
    """H5-H13 on a gap-filled series (all windows share one partition/order spec)."""
    f = rolling_features(lag_features(fourier_terms(event_flags(cyclic_features(calendar_features(ts))))))
    if with_ewm:
        f = ewm_features(f)
    f = prev_day_drivers(f)
    return time_index(f) if with_time_index else f


def ewm_state(ts: DataFrame, windows=ROLLING_WINDOWS, col: str = "log_daily_revenue") -> DataFrame:
    """Per series: the EWM numerator / denominator after the last day, and the first day.

    num = sum_j r^(T - j) x_j, den = sum_j r^(T - j) over the gap-free days j <= T:
    an ordinary aggregate (weights <= 1, no overflow).  The EWM feature of
    day T + 1 is num / den; after day T + 1 is known: num' = r num + x, den' = r den + 1.
    """
    last = ts.groupBy("series_key").agg(F.max("order_date").alias("_last"), F.min("order_date").alias("first_day"))
    j = ts.join(last, "series_key")
    age = F.datediff(F.col("_last"), F.col("order_date")).cast("double")
    aggs = []
    for w in windows:
        r = 1.0 - 2.0 / (w + 1.0)
        aggs += [F.sum(F.pow(F.lit(r), age) * F.col(col)).alias(f"_num_{w}"),
                 F.sum(F.pow(F.lit(r), age)).alias(f"_den_{w}")]
    return j.groupBy("series_key").agg(F.max("_last").alias("last_day"), F.min("first_day").alias("first_day"),
                                       *aggs)


# --- H14 / H15 ------------------------------------------------------------------------------------
def model_ready(features: DataFrame) -> DataFrame:
    """Rows with no NULL anywhere."""
    return features.dropna()


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in EXCLUDED and c != "series_key"]


def temporal_split(df: DataFrame, params: Params) -> DataFrame:
    d = F.col("order_date")
    return df.withColumn("split", F.when(d <= F.lit(params.train_end).cast("date"), "train")
                                   .when(d.between(F.lit(params.valid_start).cast("date"),
                                                   F.lit(params.valid_end).cast("date")), "valid")
                                   .when(d >= F.lit(params.test_start).cast("date"), "test"))


def leakage_check(split: DataFrame) -> DataFrame:
    """Per series, max(train) < min(valid) < min(test)."""
    g = split.groupBy("series_key").agg(
        F.max(F.when(F.col("split") == "train", F.col("order_date"))).alias("train_end"),
        F.min(F.when(F.col("split") == "valid", F.col("order_date"))).alias("valid_start"),
        F.min(F.when(F.col("split") == "test", F.col("order_date"))).alias("test_start"),
        F.count_if(F.col("split") == "train").cast("long").alias("train_rows"),
        F.count_if(F.col("split") == "valid").cast("long").alias("valid_rows"),
        F.count_if(F.col("split") == "test").cast("long").alias("test_rows"))
    return g.withColumn("no_leakage", (F.col("train_end") < F.col("valid_start"))
                        & (F.col("valid_start") < F.col("test_start")))


# --- H16 / H17 -------------------------------------------------------------------------------------
def baselines(features: DataFrame) -> DataFrame:
    """Naive (yesterday) and 7-day moving average in log space (then expm1), plus raw MA."""
    w = series_window()
    fr = w.rowsBetween(-7, -1)
    return features.withColumns({
        "pred_naive": F.lag("daily_revenue", 1).over(w),
        "pred_ma7_log": F.expm1(_full(fr, 7, F.avg("log_daily_revenue"))),
        "pred_ma7_raw": _full(fr, 7, F.avg("daily_revenue")),
    })


def long_predictions(df: DataFrame, pred_cols: dict[str, str], y: str = "daily_revenue") -> DataFrame:
    """(series_key, order_date, model, y, pred) rows from prediction columns."""
    parts = [df.select("series_key", "order_date", F.lit(m).alias("model"), F.col(y).alias("y"),
                       F.col(c).cast("double").alias("pred")) for m, c in pred_cols.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def regression_metrics(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R^2, MAPE (over y != 0) per group."""
    by = by or ["series_key", "model"]
    p = preds.where(F.col("pred").isNotNull())
    # the total sum of squares in the same partial aggregate, not from a mean over a window
    total = F.var_pop("y") * F.count("y")
    err = F.col("y") - F.col("pred")
    return (p.groupBy(*by)
             .agg(F.count(F.lit(1)).cast("long").alias("n"),
                  F.avg(F.abs(err)).alias("mae"),
                  F.sqrt(F.avg(err * err)).alias("rmse"),
                  (F.lit(1.0) - F.try_divide(F.sum(err * err), total)).alias("r2"),
                  (F.avg(F.when(F.col("y") != 0, F.abs(err / F.col("y")))) * 100.0).alias("mape")))


# --- H22 ------------------------------------------------------------------------------------------
def normal_cdf(x: Column) -> Column:
    """Standard normal CDF, Abramowitz & Stegun 26.2.17 (|error| < 7.5e-8)."""
    # Coefficients of the approximation.
    p, b1, b2, b3, b4, b5 = 0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = t * (F.lit(b1) + t * (F.lit(b2) + t * (F.lit(b3) + t * (F.lit(b4) + t * F.lit(b5)))))
    upper = F.exp(-z * z / 2.0) / F.lit(math.sqrt(2 * math.pi)) * poly
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def diebold_mariano(errors: DataFrame, e1: str, e2: str, h: int = 1, by: list[str] | None = None) -> DataFrame:
    """One-sided DM test with the Harvey small-sample correction; (0, 1) when n < 2 or sd = 0."""
    by = by or ["series_key"]
    d = F.pow(F.col(e1), 2) - F.pow(F.col(e2), 2)
    g = errors.where(F.col(e1).isNotNull() & F.col(e2).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_d"), F.var_samp(d).alias("var_d"))
    dm = (F.col("mean_d") / F.sqrt(F.col("var_d") / F.col("n"))
          * F.sqrt((F.col("n") - 1) / (F.col("n") - h)))
    ok = (F.col("n") >= 2) & F.col("var_d").isNotNull() & (F.col("var_d") > 0)
    return g.select(*by, F.col("n").cast("long").alias("n"),
                    F.when(ok, dm).otherwise(F.lit(0.0)).alias("dm_stat"),
                    F.when(ok, normal_cdf(dm)).otherwise(F.lit(1.0)).alias("p_value"))


# --- H25 / H26 / H29-H32 ------------------------------------------------------------------------------
def residual_interval(valid: DataFrame, target: DataFrame, z: float = 1.96) -> DataFrame:
    """Pred +- z * std(valid residual) (population std); lower bound clipped at 0."""
    s = (valid.where(F.col("pred").isNotNull()).groupBy("series_key", "model")
              .agg(F.stddev_pop(F.col("y") - F.col("pred")).alias("resid_std")))
    return (target.join(s, ["series_key", "model"])
                  .withColumn("lower", F.greatest(F.col("pred") - F.lit(z) * F.col("resid_std"), F.lit(0.0)))
                  .withColumn("upper", F.col("pred") + F.lit(z) * F.col("resid_std")))


def interval_coverage(intervals: DataFrame) -> DataFrame:
    """Share of actuals inside [lower, upper]."""
    inside = ((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("double")
    return intervals.where(F.col("pred").isNotNull()).groupBy("series_key", "model").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg(inside).alias("coverage"))


def error_table(preds: DataFrame) -> DataFrame:
    """Residual, absolute and percentage error (denominator >= 1)."""
    res = F.col("y") - F.col("pred")
    return preds.where(F.col("pred").isNotNull()).select(
        "series_key", "model", "order_date", "y", "pred", res.alias("residual"), F.abs(res).alias("abs_error"),
        (F.abs(res) / F.greatest(F.abs(F.col("y")), F.lit(1.0)) * 100.0).alias("pct_error"))


def worst_days(errors: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("series_key", "model").orderBy(F.desc("abs_error"), F.asc("order_date"))
    return errors.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def monthly_error(errors: DataFrame) -> DataFrame:
    """MAE, RMSE and days per month."""
    return (errors.groupBy("series_key", "model", F.date_format("order_date", "yyyy-MM").alias("month"))
                  .agg(F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
                       F.count(F.lit(1)).cast("long").alias("days")))


def monthly_rollup(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sums by month."""
    return (df.groupBy("series_key", F.date_format("order_date", "yyyy-MM").alias("month"))
              .agg(*[F.sum(c).alias(c) for c in cols]))


def merge_history_forecast(history: DataFrame, forecast: DataFrame, scale: float = 1.0) -> DataFrame:
    """Full outer join of monthly history and forecast (values divided by ``scale``)."""
    h = history.select("series_key", "month", (F.col("daily_revenue") / scale).alias("actual"))
    f = forecast.select("series_key", "month", (F.col("pred") / scale).alias("forecast"),
                        (F.col("lower") / scale).alias("lower"), (F.col("upper") / scale).alias("upper"))
    return h.join(f, ["series_key", "month"], "full")


# --- H33 / H34 ------------------------------------------------------------------------------------
def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample std per (series, feature), long form."""
    stacked = df.select("series_key", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s"))
    return (stacked.select("series_key", "s.feature", "s.v").groupBy("series_key", "feature")
                   .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")))


def drift_features(ready: DataFrame, train_stats: DataFrame, cols: list[str],
                   window: int = DRIFT_RECENT_WINDOW) -> DataFrame:
    """H34 detail: last ``window`` rows vs training stats; z per non-calendar feature."""
    cols = [c for c in cols if c not in CALENDAR_ONLY and not c.startswith("fourier_")]
    rev = Window.partitionBy("series_key").orderBy(F.desc("order_date"))
    recent = ready.withColumn("_r", F.row_number().over(rev)).where(F.col("_r") <= window)
    rs = feature_stats(recent, cols).withColumnRenamed("mean", "recent_mean").withColumnRenamed("std", "recent_std")
    ts = train_stats.withColumnRenamed("mean", "train_mean").withColumnRenamed("std", "train_std")
    denom = (F.when(F.coalesce(F.col("train_std"), F.lit(0.0)) > 0, F.col("train_std"))
              .when(F.abs(F.col("train_mean")) * 0.01 != 0, F.abs(F.col("train_mean")) * 0.01)
              .otherwise(F.lit(1.0)))
    return (rs.join(ts, ["series_key", "feature"])
              .withColumn("z_score", F.round((F.col("recent_mean") - F.col("train_mean")) / denom, 2)))


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts >= 2 (watch) and >= 3 (drift); drifted if >= 15 % drift or >= 40 % watch,
    watch if >= 10 % watch; score = max |z|."""
    a = F.abs(F.col("z_score"))
    s = drift.groupBy("series_key").agg(F.count(F.lit(1)).cast("long").alias("n_features"),
                                        F.count_if(a >= Z_WATCH).cast("long").alias("n_watch"),
                                        F.count_if(a >= Z_DRIFT).cast("long").alias("n_drifted"),
                                        F.coalesce(F.max(a), F.lit(0.0)).alias("score"))
    wr = F.col("n_watch") / F.col("n_features")
    dr = F.col("n_drifted") / F.col("n_features")
    return s.withColumn("status", F.when((dr >= 0.15) | (wr >= 0.40), "drifted")
                                   .when(wr >= 0.10, "watch").otherwise("healthy"))


def top_drift(drift: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("series_key").orderBy(F.desc(F.abs(F.col("z_score"))), F.asc("feature"))
    return drift.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
