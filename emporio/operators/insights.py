"""Derived metrics and threshold rules over query results.

Inputs are the small aggregate frames of the dashboard queries (one row
per month / category / state, or a single KPI row), so every rule is an
ordinary column expression; results are frames of
``(domain, type, severity, metric, subject, value)`` rows -- numbers and
labels, not prose.  Windows without a partition key only ever run over
these bounded frames (months, categories, states, personas).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..functions.filters import Slice
from . import dashboard as D

INSIGHT_SCHEMA = ["domain", "type", "severity", "metric", "subject", "value"]


def _rule(cond: Column, domain: str, type_, severity, metric: str, subject: Column | None,
          value: Column) -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    typ = type_ if isinstance(type_, Column) else F.lit(type_)
    return F.when(cond, F.struct(F.lit(domain).alias("domain"), typ.alias("type"),
                                 sev.alias("severity"), F.lit(metric).alias("metric"),
                                 (subject if subject is not None else F.lit(None).cast("string")).alias("subject"),
                                 value.cast("double").alias("value")))


def _emit(row: DataFrame, rules: list[Column]) -> DataFrame:
    return (row.select(F.explode(F.array(*rules)).alias("r")).where(F.col("r").isNotNull())
               .select("r.*"))


def _one(df: DataFrame) -> DataFrame:
    """Guarantee exactly one row (NULLs when ``df`` is empty): left join to a unit row."""
    unit = df.sparkSession.range(1).select(F.lit(1).alias("_u"))
    return unit.join(df, how="left").drop("_u")


# --- G1 / G3 --------------------------------------------------------------------------------
growth_pct = D.growth_pct


def trend_label(change: Column) -> Column:
    """Up / down / neutral (NULL counts as neutral)."""
    return (F.when(change.isNull(), "neutral").when(change > 0, "up").when(change < 0, "down")
            .otherwise("neutral"))


# --- G2 ------------------------------------------------------------------------------------
def latest_full_month(trend: DataFrame, selected_month: str | None, params: Params) -> DataFrame:
    """The month KPIs compare against, and its growth over the month before.

    Selected month if given; else the last month, or the one before it
    when the last is nearly empty and there are at least three months:
    revenue under ``near_empty_month_revenue``, or with
    ``near_empty_month_share`` under that share of the earlier months' mean.  One row (NULLs if undefined).
    """
    w = Window.orderBy("order_month")
    t = (trend.select("order_month", "total_revenue", "total_orders")
              .withColumn("idx", F.row_number().over(w) - 1)
              .withColumn("prev_revenue", F.lag("total_revenue").over(w))
              .withColumn("prev_orders", F.lag("total_orders").over(w)))
    n = t.agg(F.count(F.lit(1)).alias("n"),
              F.max_by("total_revenue", "order_month").alias("last_revenue"),
              F.sum("total_revenue").alias("sum_revenue"))
    share, last = params.near_empty_month_share, F.col("last_revenue")
    near_empty = (last < params.near_empty_month_revenue if share is None
                  else last * (F.col("n") - 1) < share * (F.col("sum_revenue") - last))
    if selected_month:
        target = t.where(F.col("order_month") == selected_month).select("idx")
        pick = _one(target).select(F.col("idx").alias("target_idx"))
    else:
        pick = n.select(F.when(F.col("n") < 2, F.lit(None).cast("int"))
                         .when(near_empty & (F.col("n") >= 3),
                               F.col("n") - 2)
                         .otherwise(F.col("n") - 1).alias("target_idx"))
    j = _one(pick).join(t, (F.col("idx") == F.col("target_idx")) & (F.col("target_idx") > 0), "left")
    return j.select(F.col("order_month").alias("target_month"),
                    growth_pct(F.col("total_revenue"), F.col("prev_revenue")).alias("revenue_growth"),
                    growth_pct(F.col("total_orders").cast("double"), F.col("prev_orders").cast("double"))
                    .alias("order_growth"))


# --- G4 / G5 / G6 ----------------------------------------------------------------------------
def with_share(df: DataFrame, total: DataFrame | None = None, value: str = "total_revenue",
               name: str = "revenue_share_pct") -> DataFrame:
    """Value / total * 100.  ``total`` is a one-row frame holding the
    overall total (for top-N lists the denominator is the overall total,
    not the sum of the listed rows); without it the frame's own sum."""
    if total is None:
        tot = F.sum(value).over(Window.partitionBy())   # bounded frame (groups of a dimension)
        return df.withColumn(name, F.when(tot > 0, F.col(value) / tot * 100.0).otherwise(F.lit(0.0)))
    t = total.select(F.col(total.columns[0])).scalar()     # one-row total as a scalar subquery
    return df.withColumn(name, F.when(t > 0, F.col(value) / t * 100.0).otherwise(F.lit(0.0)))


def bottom_n(df: DataFrame, key: str, n: int = 5, min_groups: int = 10, value: str = "total_revenue") -> DataFrame:
    """The n smallest by value, only when there are more than ``min_groups`` groups."""
    w = Window.orderBy(F.asc(value), F.asc(key))
    return (df.withColumn("_rank", F.row_number().over(w))
              .withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy()))
              .where((F.col("_rank") <= n) & (F.col("_groups") > min_groups)).drop("_rank", "_groups"))


def repeat_rate(total: str = "total_customers") -> Column:
    """Repeat / total * 100 (0 when there are no customers)."""
    return F.when(F.col(total) > 0,
                  F.col("repeat_customers").cast("double") / F.col(total).cast("double") * 100.0) \
            .otherwise(F.lit(0.0))


# --- G13 -------------------------------------------------------------------------------------
def month_extremes(trend: DataFrame, kpis: DataFrame, month_selected: bool = False) -> DataFrame:
    """Best / worst month, active months, monthly average revenue."""
    m = trend.agg(F.max_by("order_month", F.struct("total_revenue", F.col("order_month"))).alias("best_month"),
                  F.max("total_revenue").alias("best_revenue"),
                  F.min_by("order_month", F.struct("total_revenue", F.col("order_month"))).alias("worst_month"),
                  F.min("total_revenue").alias("worst_revenue"),
                  F.count_if(F.col("total_revenue") > 0).alias("active_months"))
    months = F.lit(1) if month_selected else F.greatest(F.col("active_months"), F.lit(1))
    return (m.crossJoin(kpis.select("total_revenue"))   # two one-row aggregates
             .select("best_month", "best_revenue", "worst_month", "worst_revenue",
                     F.col("active_months").cast("long").alias("active_months"),
                     (F.col("total_revenue") / months).alias("monthly_average")))


# --- G15 / G16 ------------------------------------------------------------------------------
def growth_sentiment(g: Column) -> Column:
    return F.when(g.isNull(), "neutral").when(g >= 5, "positive").when(g <= -5, "warning").otherwise("neutral")


def share_sentiment(s: Column) -> Column:
    return F.when(s.isNull(), "neutral").when(s > 40, "warning").when(s < 20, "positive").otherwise("neutral")


def score_sentiment(x: Column, good: float, fair: float) -> Column:
    return F.when(x >= good, "positive").when(x >= fair, "neutral").otherwise("warning")


def customer_sentiment(at_risk_ratio: Column, repeat_pct: Column, at_risk_above: float = 0.4) -> Column:
    return (F.when((at_risk_ratio > at_risk_above) | (repeat_pct < 5), "warning")
             .when(repeat_pct > 20, "positive").otherwise("neutral"))


# --- KPI row shared by G13-G22 -------------------------------------------------------------
def kpi_row(ctx, s: Slice, params: Params) -> DataFrame:
    """One row: KPIs, growth of the target month, top category/state and shares, repeat %."""
    kpis = D.overall_kpis(ctx, s)
    trend = D.monthly_trend(ctx, s)
    growth = latest_full_month(trend, s.month, params)
    topcat = D.category_performance(ctx, s, 1).select(
        F.col("product_category").alias("top_category"), F.col("total_revenue").alias("top_category_revenue"))
    topstate = D.state_performance(ctx, s, 1).select(
        F.col("state_code").alias("top_state"), F.col("total_revenue").alias("top_state_revenue"))
    snap = D.customer_snapshot(ctx, s).select("repeat_customers", "one_time_customers",
                                             F.col("total_customers").alias("snapshot_customers"))
    # every part is a single row (KPIs, growth, top-1 category/state, snapshot)
    row = (kpis.crossJoin(growth).join(topcat, how="left").join(topstate, how="left").crossJoin(snap))
    share = lambda c: F.when(F.col("total_revenue") > 0, F.col(c) / F.col("total_revenue") * 100.0)
    return (row.withColumn("top_category_share", share("top_category_revenue"))
               .withColumn("top_state_share", share("top_state_revenue"))
               .withColumn("repeat_pct", repeat_rate("snapshot_customers")))


def sentiment_flags(row: DataFrame) -> DataFrame:
    """G15 (the data-derived part): sentiment per report section."""
    return row.select(growth_sentiment(F.col("revenue_growth")).alias("revenue_sentiment"),
                      share_sentiment(F.col("top_category_share")).alias("category_sentiment"),
                      share_sentiment(F.col("top_state_share")).alias("geography_sentiment"),
                      F.when(F.col("repeat_pct") < 5, "warning").when(F.col("repeat_pct") > 20, "positive")
                      .otherwise("neutral").alias("customer_sentiment"))


def customer_health(counts: DataFrame, repeat_pct: Column, at_risk_above: float = 0.4) -> DataFrame:
    """G15 / G16, the persona part: customer sentiment and the at-risk flag (one row).

    ``counts`` is the G14 row; the share of at-risk personas is taken of
    all clustered customers, whatever slice the other numbers are for.
    """
    ratio = F.col("at_risk_ratio")
    return counts.select("at_risk", "cluster_total", (ratio * 100.0).alias("at_risk_pct"),
                         customer_sentiment(ratio, repeat_pct, at_risk_above).alias("customer_sentiment"),
                         (ratio > at_risk_above).alias("at_risk_flag"))


def risk_flags(row: DataFrame, health: DataFrame | None = None, repeat_below: float = 10.0,
               share_above: float = 40.0) -> DataFrame:
    """The raised risks, one row each; with ``health`` (one row) the at-risk customers among them."""
    repeat, category, state = F.col("repeat_pct"), F.col("top_category_share"), F.col("top_state_share")
    raised = _emit(row, [
        _rule((repeat < repeat_below) & (F.col("total_customers") > 0), "summary", "risk", "warning", "repeat_pct", None, repeat),
        _rule(category > share_above, "summary", "risk", "warning", "top_category_share", F.col("top_category"), category),
        _rule(state > share_above, "summary", "risk", "warning", "top_state_share", F.col("top_state"), state),
    ])
    if health is None:
        return raised
    at_risk = F.col("at_risk_pct")
    return raised.unionByName(_emit(health, [
        _rule(F.col("at_risk_flag"), "summary", "risk", "warning", "at_risk_pct", None, at_risk)]))


# --- G17-G22 ----------------------------------------------------------------------------------
def executive_insights(row: DataFrame) -> DataFrame:
    g, sh, rp, og = (F.col("revenue_growth"), F.col("top_state_share"), F.col("repeat_pct"),
                     F.col("order_growth"))
    return _emit(row, [
        _rule(g.isNotNull(), "executive", "growth",
              F.when(g > 10, "positive").when(g < -5, "critical").otherwise("neutral"),
              "revenue_growth", F.col("top_category"), g),
        _rule(F.col("top_state").isNotNull() & sh.isNotNull(), "executive",
              F.when(sh > 40, "warning").otherwise("trend"), F.when(sh > 40, "warning").otherwise("positive"),
              "top_state_share", F.col("top_state"), sh),
        _rule(rp.isNotNull() & ((rp < 5) | (rp > 20)), "executive", "segment",
              F.when(rp < 5, "warning").otherwise("positive"), "repeat_pct", None, rp),
        _rule(og.isNotNull() & (og > 15), "executive", "growth", "positive", "order_growth", None, og),
    ])


def sales_insights(categories: DataFrame, trend: DataFrame) -> DataFrame:
    """Top / bottom category; last-vs-previous month change when >= 3 months."""
    w = Window.orderBy(F.desc("total_revenue"), F.asc("product_category"))
    c = (categories.withColumn("_r", F.row_number().over(w))
                   .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    top = c.where("_r = 1").select(F.lit("sales").alias("domain"), F.lit("trend").alias("type"),
                                   F.lit("positive").alias("severity"), F.lit("top_category").alias("metric"),
                                   F.col("product_category").alias("subject"),
                                   F.col("total_revenue").cast("double").alias("value"))
    bottom = c.where("_r = _n AND _n > 1 AND total_revenue > 0").select(
        F.lit("sales").alias("domain"), F.lit("warning").alias("type"), F.lit("warning").alias("severity"),
        F.lit("bottom_category").alias("metric"), F.col("product_category").alias("subject"),
        F.col("total_revenue").cast("double").alias("value"))
    wm = Window.orderBy(F.desc("order_month"))
    t = trend.withColumn("_r", F.row_number().over(wm)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    last2 = t.where("_r <= 2 AND _n >= 3").agg(F.max(F.when(F.col("_r") == 1, F.col("total_revenue"))).alias("cur"),
                                              F.max(F.when(F.col("_r") == 2, F.col("total_revenue"))).alias("prev"))
    change = (F.col("cur") - F.col("prev")) / F.col("prev") * 100.0
    monthly = _emit(last2, [_rule(F.col("prev") > 0, "sales", "trend",
                                  F.when(change > 0, "positive").otherwise("warning"),
                                  "monthly_revenue_change", None, change)])
    return top.unionByName(bottom).unionByName(monthly)


def customer_insights(snapshot_overview: DataFrame) -> DataFrame:
    """Repeat rate (positive above 10 %), average lifetime spend."""
    rp = F.when(F.col("total_customers") > 0,
                F.col("repeat_customers").cast("double") / F.col("total_customers").cast("double") * 100.0) \
          .otherwise(F.lit(0.0))
    return _emit(snapshot_overview, [
        _rule(F.lit(True), "customers", "segment", F.when(rp > 10, "positive").otherwise("warning"),
              "repeat_pct", None, rp),
        _rule(F.col("avg_lifetime_spend") > 0, "customers", "trend", "neutral", "avg_lifetime_spend", None,
              F.col("avg_lifetime_spend")),
    ])


def geography_insights(states: DataFrame, totals: DataFrame) -> DataFrame:
    """leader's share; share of the bottom five when there are >= 5 states."""
    w = Window.orderBy(F.desc("total_revenue"), F.asc("state_code"))
    s = (states.withColumn("_r", F.row_number().over(w))
               .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    tot = totals.select(F.col("total_revenue").alias("_tot"))
    lead = (s.where("_r = 1").crossJoin(tot).where("_tot > 0")   # one row x one-row total
             .select(F.lit("geography").alias("domain"), F.lit("trend").alias("type"),
                     F.lit("positive").alias("severity"), F.lit("leader_share").alias("metric"),
                     F.col("state_code").alias("subject"),
                     (F.col("total_revenue") / F.col("_tot") * 100.0).alias("value")))
    bottom = (s.where("_n >= 5 AND _r > _n - 5").agg(F.sum("total_revenue").alias("_b")).crossJoin(tot)  # 1 x 1
               .where("_tot > 0 AND _b IS NOT NULL")
               .select(F.lit("geography").alias("domain"), F.lit("warning").alias("type"),
                       F.lit("warning").alias("severity"), F.lit("bottom5_share").alias("metric"),
                       F.lit(None).cast("string").alias("subject"),
                       (F.col("_b") / F.col("_tot") * 100.0).alias("value")))
    return lead.unionByName(bottom)


def product_insights(categories: DataFrame) -> DataFrame:
    """Share of the top and of the bottom category in all category revenue."""
    w = Window.orderBy(F.desc("total_revenue"), F.asc("product_category"))
    c = (categories.withColumn("_r", F.row_number().over(w))
                   .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
                   .withColumn("_tot", F.sum("total_revenue").over(Window.partitionBy())))
    share = F.when(F.col("_tot") > 0, F.col("total_revenue") / F.col("_tot") * 100.0)
    top = c.where("_r = 1").select(F.lit("products").alias("domain"), F.lit("trend").alias("type"),
                                   F.lit("positive").alias("severity"), F.lit("top_category_share").alias("metric"),
                                   F.col("product_category").alias("subject"), share.alias("value"))
    bot = c.where("_r = _n AND _n > 1").select(F.lit("products").alias("domain"), F.lit("warning").alias("type"),
                                               F.lit("warning").alias("severity"),
                                               F.lit("bottom_category_share").alias("metric"),
                                               F.col("product_category").alias("subject"), share.alias("value"))
    return top.unionByName(bot)


def consolidated_insights(ctx, s: Slice, params: Params) -> DataFrame:
    """The five insight sets, tagged with their domain."""
    row = kpi_row(ctx, s, params)
    cats = D.category_performance(ctx, s)
    parts = [
        executive_insights(row),
        sales_insights(cats, D.monthly_trend(ctx, s, honour_month=True, with_customers=False)),
        customer_insights(D.customer_overview(ctx, s)),
        geography_insights(D.all_states(ctx, s), D.state_totals(ctx, s.without("state"))),
        product_insights(cats),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
