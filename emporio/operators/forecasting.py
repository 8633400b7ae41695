"""Model fits with pyspark.ml, and what follows from their predictions.

The feature table comes from ``timeseries`` (all series at once, one row
per series and day).  Models are fitted on the log target with
``RandomForestRegressor``, ``GBTRegressor`` and ``LinearRegression`` --
distributed learners, so a fit scales with the number of series x days.
The loops here are over model configurations, folds and forecast steps (a
handful each), never over rows.

Weights, blend and champion (H20, H21) are DataFrame operations on one
prediction table (model, split, series_key, order_date, y, pred_log),
whatever the models are; so is the importance of features (H28) for any
function that adds a prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..functions.keys import with_dense_key
from ..session import ensure_checkpoint_dir
from . import timeseries as T

SEED = 42
PROMOTE_THRESHOLD = 0.005

# 12 trials per model family, as in the reference's search budget
RF_GRID = [{"numTrees": n, "maxDepth": d} for n in (20, 50, 100) for d in (4, 6, 8, 10)]
GBT_GRID = [{"maxIter": n, "maxDepth": d} for n in (10, 20, 30) for d in (3, 4, 5, 6)]
LINEAR_GRID = [{"regParam": r, "elasticNetParam": a} for r in (0.001, 0.01, 0.1, 1.0) for a in (0.0, 0.5, 1.0)]
FAMILIES = {"random_forest": RF_GRID, "gbt": GBT_GRID, "linear": LINEAR_GRID}
#: Families of the blend at most.
BLEND_TOP = 3


@dataclass
class Fitted:
    name: str
    params: dict
    model: object
    valid_rmse: float | None = None


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(
        df.withColumn("label", F.col("log_daily_revenue")))


def make_estimator(family: str, params: dict):
    if family == "random_forest":
        return RandomForestRegressor(seed=SEED, featureSubsetStrategy="onethird", **params)
    if family == "gbt":
        return GBTRegressor(seed=SEED, **params)
    if family == "linear":
        return LinearRegression(**params)
    raise ValueError(family)


def predict(model, df: DataFrame, name: str) -> DataFrame:
    """(series_key, order_date, model, y, pred) with pred back on the raw scale."""
    return (model.transform(df).select("series_key", "order_date", F.lit(name).alias("model"),
                                       F.col("daily_revenue").alias("y"),
                                       F.expm1("prediction").alias("pred"), F.col("prediction").alias("pred_log")))


def _rmse(preds: DataFrame) -> float:
    # one-row aggregate: the search loop needs the number on the driver
    return preds.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("pred"), 2)))).first()[0]


def prepared(ready: DataFrame, params: Params) -> tuple[DataFrame, list[str]]:
    cols = T.feature_columns(ready)
    data = assemble(T.temporal_split(ready, params), cols)
    return data, cols


def param_search(data: DataFrame, family: str, grid: list[dict], parallelism: int = 4) -> list[Fitted]:
    """Fit every configuration on train, score raw-scale RMSE on valid.

    Trials are independent Spark jobs submitted from a small thread pool
    (as ``CrossValidator(parallelism=...)`` does), so several fits share the
    cluster at once.
    """
    from concurrent.futures import ThreadPoolExecutor
    # the daily feature table (series x days) is reused by every trial: keep it in memory
    train = data.where("split = 'train'").persist()
    valid = data.where("split = 'valid'").persist()

    def trial(p):
        m = make_estimator(family, p).fit(train)
        return Fitted(family, p, m, _rmse(predict(m, valid, family)))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        out = list(pool.map(trial, grid))
    train.unpersist()
    valid.unpersist()
    return sorted(out, key=lambda f: (f.valid_rmse, str(sorted(f.params.items()))))


def search_table(spark, fits: list[Fitted]) -> DataFrame:
    rows = [(f.name, str(sorted(f.params.items())), float(f.valid_rmse)) for f in fits]
    return spark.createDataFrame(rows, "model string, params string, valid_rmse double")


# --- H20 / H21: from the prediction table ---------------------------------------------------------
def best_of_family(fits: list[Fitted]) -> list[Fitted]:
    """The trial with the least validation RMSE of each family."""
    best: dict[str, Fitted] = {}
    for f in sorted(fits, key=lambda f: (f.valid_rmse, str(sorted(f.params.items())))):
        best.setdefault(f.name, f)
    return list(best.values())


def prediction_table(fits: list[Fitted], data: DataFrame) -> DataFrame:
    """(model, split, series_key, order_date, y, pred_log) of every model over the valid and test days."""
    part = data.where(F.col("split").isin("valid", "test"))
    return reduce(lambda a, b: a.unionByName(b), [
        f.model.transform(part).select(F.lit(f.name).alias("model"), "split", "series_key", "order_date",
                                       F.col("daily_revenue").alias("y"), F.col("prediction").alias("pred_log"))
        for f in fits])


def _rmse_of(pred: Column) -> Column:
    err = F.col("y") - pred
    return F.sqrt(F.avg(err * err))


def blend_weights(preds: DataFrame, top: int = BLEND_TOP) -> DataFrame:
    """(model, valid_rmse, rank, weight): the ``top`` models by validation RMSE on the raw scale,
    with weights proportional to 1 / RMSE.  A row per model, so the windows are small."""
    rmse = (preds.where((F.col("split") == "valid") & F.col("pred_log").isNotNull()).groupBy("model")
            .agg(_rmse_of(F.expm1("pred_log")).alias("valid_rmse")))
    order = Window.orderBy("valid_rmse", "model")
    chosen = rmse.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    inverse = F.lit(1.0) / F.col("valid_rmse")
    return chosen.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy()))


def blend(preds: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted mean of the chosen models' log predictions, per split, series and day.

    Days that one of them has no prediction for are left out.
    """
    n = weights.select(F.count(F.lit(1))).scalar()
    return (preds.where(F.col("pred_log").isNotNull()).join(weights.select("model", "weight"), "model")
            .groupBy("split", "series_key", "order_date")
            .agg(F.max("y").alias("y"), F.sum(F.col("weight") * F.col("pred_log")).alias("pred_log"),
                 F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == n)
            .select(F.lit("ensemble").alias("model"), "split", "series_key", "order_date", "y", "pred_log",
                    F.expm1("pred_log").alias("pred")))


def champion(preds: DataFrame, weights: DataFrame, threshold: float = PROMOTE_THRESHOLD) -> DataFrame:
    """H21 (one row): the ensemble only if its validation RMSE is at least ``threshold`` (relative) below the best model's."""
    best = weights.where(F.col("rank") == 1).select(F.col("model").alias("best_single"),
                                                    F.col("valid_rmse").alias("best_single_rmse"))
    ens = (blend(preds, weights).where(F.col("split") == "valid")
           .agg(_rmse_of(F.col("pred")).alias("ensemble_rmse")))
    gain = F.lit(1.0) - F.col("ensemble_rmse") / F.col("best_single_rmse")
    return (best.crossJoin(ens)    # one row each
            .withColumn("gain", gain)
            .withColumn("champion", F.when(gain >= threshold, F.lit("ensemble")).otherwise(F.col("best_single"))))


Members = list[tuple[object, float]]


def deployed(data: DataFrame, fits: list[Fitted], choice: str, weights: DataFrame) -> Members:
    """The champion fitted anew on all complete days: (model, weight) of each member."""
    by_name = {f.name: f for f in fits}
    if choice == "ensemble":
        chosen = [(r["model"], r["weight"]) for r in weights.orderBy("rank").collect()]   # at most BLEND_TOP rows
    else:
        chosen = [(choice, 1.0)]
    days = data.persist()
    out = [(make_estimator(name, by_name[name].params).fit(days), w) for name, w in chosen]
    days.unpersist()
    return out


def score(members: Members, df: DataFrame, out: str = "prediction") -> DataFrame:
    """``df`` (with ``features``) and the weighted mean of the members' predictions."""
    for i, (m, _) in enumerate(members):
        df = m.copy({m.predictionCol: f"_p{i}"}).transform(df)
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(f"_p{i}") * w for i, (_, w) in enumerate(members)])) \
             .drop(*[f"_p{i}" for i in range(len(members))])


# --- H28 ------------------------------------------------------------------------------------------
def permutation_importance(rows: DataFrame, cols: list[str], keys: list[str], predict: Callable[[DataFrame], DataFrame],
                           repeats: int = 5, seed: int = SEED) -> DataFrame:
    """(feature, rise, importance): the mean rise of the squared error when a feature's values change places.

    ``rows`` has the key columns, ``label`` and ``x``, the feature values
    as an array in the order of ``cols``; ``predict`` adds a column
    ``prediction`` for it.  Rows are numbered in a seeded hash order; in
    repeat r every row takes the feature's value of the row that stands
    1 + (7919 r mod (n - 1)) places further, around the end.  So one
    distributed numbering and one join by number serve all features and
    repeats, and all of them are scored as one stacked table, of which
    nothing but the error sums is shuffled.  Mean rises below 0 count 0;
    importances add up to 100 (to 0 if nothing rises).
    """
    by = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    ranked = with_dense_key(rows.select(*keys, "label", "x", by.alias("_h")), ["_h", *keys], "_rank").drop("_h")
    n = ranked.count()
    if n < 2:
        raise ValueError("permutation needs two rows at least")
    shift = F.lit(1) + (F.col("_repeat") * 7919) % (n - 1)
    asked = (ranked.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
             .withColumn("_from", (F.col("_rank") - 1 + shift) % n + 1))
    given = ranked.select(F.col("_rank").alias("_from"), F.col("x").alias("_other"))
    paired = asked.join(given, "_from")
    changed = F.concat(F.slice("x", 1, F.col("_j")), F.array(F.get("_other", F.col("_j"))),
                       F.slice("x", F.col("_j") + 2, F.lit(len(cols))))
    stacked = (paired.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))))
               .select("label", "_repeat", "_j", changed.alias("x")))
    plain = ranked.select("label", F.lit(0).alias("_repeat"), F.lit(-1).alias("_j"), "x")
    err = F.col("label") - F.col("prediction")
    mse = (predict(stacked.unionByName(plain)).groupBy("_repeat", "_j").agg(F.avg(err * err).alias("mse")))
    # features x repeats rows from here on
    base = F.max(F.when(F.col("_j") < 0, F.col("mse"))).over(Window.partitionBy())
    rise = (mse.withColumn("_rise", F.col("mse") - base).where(F.col("_j") >= 0)
            .groupBy("_j").agg(F.avg("_rise").alias("rise")))
    gain = F.greatest(F.col("rise"), F.lit(0.0))
    total = F.sum(gain).over(Window.partitionBy())
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_j") + 1)
    return rise.select(name.alias("feature"), "rise",
                       F.when(total > 0, gain / total * 100.0).otherwise(F.lit(0.0)).alias("importance"))


def arrayed(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``x``, the features as an array, and ``label``."""
    return df.withColumn("x", F.array(*[F.col(c).cast("double") for c in cols])).withColumn("label", F.col("log_daily_revenue"))


def scorer(members: Members) -> Callable[[DataFrame], DataFrame]:
    """A prediction from ``x`` by fitted models, for ``permutation_importance``."""
    return lambda df: score(members, df.withColumn("features", array_to_vector("x")))


# --- H23 / H24 -------------------------------------------------------------------------------------
#: (train rows, test rows) -> predictions (order_date, model, y, pred)
Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def fitted_per_fold(family: str, params: dict) -> Predictor:
    """A model fitted anew on the training rows of each fold."""
    return lambda train, test: predict(make_estimator(family, params).fit(train), test, family)


def _no_metrics(spark) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("n"),
                                 *[F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "r2", "mape")])


def walk_forward_folds(data: DataFrame, n_folds: int = 4, horizon: int = 30, min_train: int = 200) -> DataFrame:
    """The folds of H23: the last ``n_folds`` x ``horizon`` days, the last fold ending with the data.

    ``status`` says why a fold is not scored: fewer than ``min_train``
    days of training, whatever the number of series, or no test day.
    """
    days = data.select("order_date").distinct()
    last = days.select(F.max("order_date")).scalar()
    fold = F.explode(F.sequence(F.lit(1), F.lit(n_folds)))
    every = days.select("order_date", fold.alias("fold"))      # a row per day and fold
    start = F.date_add(last, (F.col("fold") - n_folds) * horizon)
    every = every.withColumn("start", start).withColumn("end", F.least(F.date_add("start", horizon - 1), last))
    day = F.col("order_date")
    found = every.groupBy("fold", "start", "end").agg(
        F.count_if(day < F.col("start")).alias("train_days"), F.count_if(day.between(F.col("start"), F.col("end"))).alias("test_days"))
    status = F.when(F.col("train_days") < min_train, "short_train").when(F.col("test_days") == 0, "no_test").otherwise("ok")
    return found.withColumn("status", status)


def walk_forward(data: DataFrame, predictor: Predictor, n_folds: int = 4, horizon: int = 30, min_train: int = 200) -> DataFrame:
    """A growing training window; every fold has a row, with metrics where it could be scored."""
    spark, day, out = data.sparkSession, F.col("order_date"), []
    for f in walk_forward_folds(data, n_folds, horizon, min_train).orderBy("fold").collect():    # ``n_folds`` rows
        met = _no_metrics(spark)
        if f["status"] == "ok":
            train, test = data.where(day < F.lit(f["start"])), data.where(day.between(F.lit(f["start"]), F.lit(f["end"])))
            met = T.regression_metrics(predictor(train, test), by=["model"])
        out.append(met.select(F.lit(f["fold"]).alias("fold"), F.lit(str(f["start"])).alias("fold_test_start"),
                              F.lit(str(f["end"])).alias("fold_test_end"), F.lit(f["status"]).alias("status"),
                              "n", "mae", "rmse", "r2", "mape"))
    return reduce(lambda a, b: a.unionByName(b), out)


def expanding_cv(data: DataFrame, predictor: Predictor, n_splits: int = 5) -> DataFrame:
    """``n_splits`` consecutive test blocks of n // (n_splits + 1) days, train = all before."""
    days = data.select("order_date").distinct()
    n = days.count()
    size = n // (n_splits + 1)
    if not size:
        raise ValueError(f"{n} days are too few for {n_splits} splits")
    ranked = days.withColumn("_i", F.row_number().over(Window.orderBy("order_date")) - 1)  # one row per day
    d = data.join(ranked, "order_date")
    out = []
    for k in range(n_splits):
        lo = n - (n_splits - k) * size
        train, test = d.where(F.col("_i") < lo), d.where((F.col("_i") >= lo) & (F.col("_i") < lo + size))
        met = T.regression_metrics(predictor(train, test), by=["model"])
        out.append(met.select(F.lit(k + 1).alias("fold"), F.lit(lo).cast("long").alias("train_size"),
                              "n", "mae", "rmse", "r2", "mape"))
    return reduce(lambda a, b: a.unionByName(b), out)


# --- H27 -------------------------------------------------------------------------------------------
CARRIED = ["total_orders", "total_items", "total_customers", "total_sellers", "avg_item_price",
           "total_freight", "avg_freight"]


#: Days of history that a step reads.
RING_DAYS = max(T.LAG_DAYS + T.ROLLING_WINDOWS)
#: Measures that a step reads; those after revenue stay as on the last known day.
RING = ["log_daily_revenue", "daily_revenue", "total_orders", "total_customers", "avg_order_value", "total_items",
        "avg_items_per_order", "total_freight", "avg_freight", "total_sellers"]


class ArrayPast(T.Past):
    """The past of a series in its state: an array per measure, the last day at its end."""

    def value(self, measure, days):
        a = F.col(f"_{measure}")
        return F.get(a, F.size(a) - days)

    def stats(self, measure, days):
        a = F.col(f"_{measure}")
        last = F.slice(a, F.greatest(F.size(a) - days + 1, F.lit(1)), F.lit(days))
        mean = F.aggregate(last, F.lit(0.0), lambda s, v: s + v) / days
        square = F.aggregate(last, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        found = {"mean": mean, "std": F.sqrt(square / (days - 1)), "min": F.array_min(last), "max": F.array_max(last)}
        return {name: F.when(F.size(a) >= days, c) for name, c in found.items()}


def forecast_state(ts: DataFrame) -> DataFrame:
    """One row per series: the last ``RING_DAYS`` days as arrays, the EWM sums, the next day."""
    base = T.add_drivers(ts.select("series_key", "order_date", *CARRIED, "daily_revenue"))
    sums = T.ewm_state(base)
    recent = (base.join(sums.select("series_key", "last_day"), "series_key")
              .where(F.col("order_date") > F.date_sub(F.col("last_day"), RING_DAYS)))
    # RING_DAYS elements at most
    days = F.array_sort(F.collect_list(F.struct("order_date", *RING)))
    rings = recent.groupBy("series_key").agg(days.alias("_days"))
    return (rings.select("series_key", *[F.col("_days").getField(m).alias(f"_{m}") for m in RING])
            .join(sums, "series_key")
            .withColumns({"order_date": F.date_add("last_day", 1), "forecast": F.expr("cast(array() as array<double>)")})
            .drop("last_day"))


def forecast_step(state: DataFrame, members: Members, cols: list[str]) -> DataFrame:
    """The state one day on: a projection, without window, join or shuffle.

    The day's features come from the arrays by the same definitions as in
    the feature table; its prediction joins them as the last day.
    """
    past = ArrayPast()
    known = T.fourier_terms(T.event_flags(T.cyclic_features(T.calendar_features(state))))
    made = {**T.lag_columns(past), **T.rolling_columns(past), **T.prev_day_columns(past),
            **{f"log_rev_roll_ema_{w}": F.col(f"_num_{w}") / F.col(f"_den_{w}") for w in T.ROLLING_WINDOWS},
            "time_index": F.datediff("order_date", "first_day")}
    # a feature that the history is too short for is NaN, as in ``assemble``
    features = F.array(*[F.coalesce((made[c] if c in made else F.col(c)).cast("double"), F.lit(float("nan"))) for c in cols])
    day = score(members, known.select(*state.columns, array_to_vector(features).alias("features")))
    day = day.withColumn("_new", F.greatest(F.expm1("prediction"), F.lit(0.0))).drop("features", "prediction")
    log = F.log1p("_new")
    fresh = {"daily_revenue": F.col("_new"), "log_daily_revenue": log,
             "avg_order_value": F.col("_new") / F.greatest(past.value("total_orders", 1), F.lit(1.0))}
    moved = {}
    for m in RING:
        longer = F.concat(F.col(f"_{m}"), F.array(fresh.get(m, past.value(m, 1))))
        moved[f"_{m}"] = F.slice(longer, F.greatest(F.size(longer) - RING_DAYS + 1, F.lit(1)), F.lit(RING_DAYS))
    for w in T.ROLLING_WINDOWS:
        r = 1.0 - 2.0 / (w + 1.0)
        moved[f"_num_{w}"] = F.col(f"_num_{w}") * r + log
        moved[f"_den_{w}"] = F.col(f"_den_{w}") * r + 1.0
    moved |= {"forecast": F.concat("forecast", F.array("_new")), "order_date": F.date_add("order_date", 1)}
    return day.select(*[moved.get(c, F.col(c)).alias(c) for c in state.columns])


def recursive_forecast(ts: DataFrame, members: Members | object, cols: list[str], horizon: int = T.FORECAST_HORIZON,
                       steps: int = 10) -> DataFrame:
    """Forecast ``horizon`` days, each day's prediction becoming history.

    Every series is one row that carries its last ``RING_DAYS`` days in
    arrays, so a step works on all series at once without moving a row.
    The state is written to the shared checkpoint folder after every
    ``steps`` steps, which cuts the plan.  Drivers stay as on the last
    known day.  ``members`` is one fitted model or (model, weight) pairs.
    """
    spark = ts.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/emporio-forecast/{uuid.uuid4().hex}"
    members = members if isinstance(members, list) else [(members, 1.0)]

    def pin(df, k):
        path = f"{root}/{k}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    state = pin(forecast_state(ts), 0)
    for k in range(1, horizon + 1):
        state = forecast_step(state, members, cols)
        if k % steps == 0 or k == horizon:
            state = pin(state, k)
    day = F.date_add(F.date_sub("order_date", horizon), F.col("pos"))
    return (state.select("series_key", "order_date", F.posexplode("forecast").alias("pos", "pred"))
            .select("series_key", day.alias("order_date"), "pred"))
