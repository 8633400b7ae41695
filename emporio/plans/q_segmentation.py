"""I registrations, plus the persona-dependent F and G queries.

Two labellings feed the same operators:

* rule labels -- the revenue quintile (RFM M score) as ``cluster_id``:
  deterministic, so profiles, personas, confidence, cluster-quality
  metrics and every persona query below are checked against SQL;
* K-Means labels (pyspark.ml) on the PCA-reduced scaled features: the
  reference's model path, checked for rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..operators import segmentation as S
from .oracle import with_base
from .registry import register

FEATS = S.CLUSTERING_FEATURES


def rnd(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- Spark side ------------------------------------------------------------------------------------
def features(ctx) -> DataFrame:
    return ctx.memo("customer_features", lambda: ctx._store(
        S.behaviour_features(S.customer_aggregates(ctx.enriched), ctx.params), "customer_features"))


def rfm(ctx) -> DataFrame:
    return ctx.memo("rfm_scores", lambda: ctx._store(S.rfm_scores(features(ctx)), "rfm_scores"))


def rule_labels(ctx) -> DataFrame:
    return rfm(ctx).select("customer_unique_id", (F.col("m_score") - 1).alias("cluster_id"))


def rule_personas(ctx) -> DataFrame:
    """customer -> (cluster_id, persona, distance_to_center, confidence_score) for the rule labels."""
    return ctx.memo("rule_personas", lambda: _build_rule_personas(ctx))


def _build_rule_personas(ctx) -> DataFrame:
    labels = rule_labels(ctx)
    prof = S.assign_personas(S.cluster_profiles(features(ctx), labels))
    logf = S.log_features(features(ctx)).join(labels, "customer_unique_id")
    cen = S.centroids(logf, FEATS).collect()          # K x d numbers (K = 5, d = 11)
    k = 1 + max(r["label"] for r in cen)
    centers = [[0.0] * len(FEATS) for _ in range(k)]
    for r in cen:
        centers[r["label"]][r["dim"]] = r["c"]
    conf = S.assignment_confidence(logf, centers, cols=FEATS)
    return ctx._store(
        conf.join(F.broadcast(prof.select("cluster_id", "persona")), "cluster_id")   # K rows
            .select("customer_unique_id", "cluster_id", "persona", "distance_to_center", "confidence_score",
                    "range_confidence"), "rule_personas")


def rule_segments(ctx) -> DataFrame:
    """customer -> (rule segment, lifetime revenue, orders) from the fact."""
    return (ctx.fact.groupBy("customer_unique_id")
            .agg(F.max("segment").alias("segment"), F.sum("total_sales_amount").cast("double").alias("revenue"),
                 F.countDistinct("order_id").cast("long").alias("orders")))


# --- SQL side --------------------------------------------------------------------------------------
def _cust_ctes(p: Params) -> str:
    logs = ", ".join(f"ln(1 + greatest(CAST({c} AS DOUBLE), 0.0)) AS {c}" for c in FEATS)
    return f"""
ca AS (SELECT customer_unique_id, count(DISTINCT order_id) AS number_of_orders,
              CAST(sum(total_sales_amount) AS DOUBLE) AS total_revenue,
              CAST(sum(total_sales_amount) AS DOUBLE) / count(total_sales_amount) AS average_order_value,
              CAST(sum(quantity) AS BIGINT) AS total_items_purchased, count(DISTINCT product_id) AS unique_products,
              count(DISTINCT product_category_name_english) AS unique_categories,
              CAST(sum(freight_value) AS DOUBLE) / count(freight_value) AS avg_freight,
              min(order_date) AS first_purchase_date, max(order_date) AS last_purchase_date,
              COALESCE(max(state_code), 'UNKNOWN') AS customer_state
       FROM enriched WHERE customer_unique_id IS NOT NULL GROUP BY 1),
cf AS (SELECT *, CAST(datediff('day', last_purchase_date, DATE '{p.rfm_reference_date}') AS INTEGER) AS recency_days,
              CAST(datediff('day', first_purchase_date, last_purchase_date) AS INTEGER) AS customer_tenure_days,
              total_items_purchased / number_of_orders AS items_per_order,
              unique_categories / total_items_purchased AS category_diversity_ratio,
              unique_products / total_items_purchased AS product_diversity_ratio,
              avg_freight / greatest(average_order_value, 1.0) AS freight_revenue_ratio,
              CAST(datediff('day', first_purchase_date, last_purchase_date) AS INTEGER)
                / greatest(CAST(number_of_orders AS DOUBLE), 1.0) AS avg_purchase_interval_days
       FROM ca),
qe AS (SELECT quantile_cont(CAST(recency_days AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS r,
              quantile_cont(total_revenue, [0.2, 0.4, 0.6, 0.8]) AS m FROM cf),
rfm AS (SELECT customer_unique_id, recency_days, number_of_orders, total_revenue,
               CAST(6 - (1 + CAST(recency_days > r[1] AS INTEGER) + CAST(recency_days > r[2] AS INTEGER)
                        + CAST(recency_days > r[3] AS INTEGER) + CAST(recency_days > r[4] AS INTEGER)) AS INTEGER) AS r_score,
               CAST(CASE WHEN number_of_orders > 0 AND number_of_orders <= 1 THEN 1
                         WHEN number_of_orders > 1 AND number_of_orders <= 2 THEN 2
                         WHEN number_of_orders > 2 AND number_of_orders <= 5 THEN 3
                         WHEN number_of_orders > 5 AND number_of_orders <= 100 THEN 4 ELSE 1 END AS INTEGER) AS f_score,
               CAST(1 + CAST(total_revenue > m[1] AS INTEGER) + CAST(total_revenue > m[2] AS INTEGER)
                      + CAST(total_revenue > m[3] AS INTEGER) + CAST(total_revenue > m[4] AS INTEGER) AS INTEGER) AS m_score
        FROM cf, qe),
rfm2 AS (SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score FROM rfm),
lab AS (SELECT customer_unique_id, m_score - 1 AS cluster_id FROM rfm),
lf AS (SELECT cf.customer_unique_id, lab.cluster_id, {logs} FROM cf JOIN lab ON cf.customer_unique_id = lab.customer_unique_id),
prof0 AS (SELECT cluster_id, count(*) AS customer_count, sum(total_revenue) AS total_segment_revenue,
                 avg(recency_days) AS avg_recency, avg(number_of_orders) AS avg_orders, avg(total_revenue) AS avg_revenue,
                 avg(average_order_value) AS avg_aov, avg(total_items_purchased) AS avg_items,
                 avg(unique_categories) AS avg_categories, avg(avg_freight) AS avg_freight
          FROM cf JOIN lab ON cf.customer_unique_id = lab.customer_unique_id GROUP BY 1),
prof AS (SELECT *, customer_count / sum(customer_count) OVER () * 100.0 AS pct_customers,
                total_segment_revenue / sum(total_segment_revenue) OVER () * 100.0 AS revenue_share_pct FROM prof0),
pb AS (SELECT *, CASE WHEN avg_orders > rep_thr AND avg_revenue >= pavg THEN '{S.PERSONAS[0]}'
                      WHEN avg_revenue >= pavg AND avg_recency > rec_med THEN '{S.PERSONAS[1]}'
                      WHEN avg_revenue >= pavg THEN '{S.PERSONAS[2]}'
                      WHEN avg_recency > rec_med THEN '{S.PERSONAS[3]}' ELSE '{S.PERSONAS[4]}' END AS base
       FROM (SELECT *, sum(total_segment_revenue) OVER () / sum(customer_count) OVER () AS pavg,
                    quantile_cont(avg_recency, 0.5) OVER () AS rec_med,
                    quantile_cont(avg_orders, 0.5) OVER () + 0.5 AS rep_thr FROM prof) x),
pers AS (SELECT *, CASE WHEN rn = 1 THEN base WHEN base = '{S.PERSONAS[0]}' THEN base || ' (Core)'
                        ELSE base || ' (Long-Term)' END AS persona
         FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY avg_recency DESC, cluster_id) AS rn FROM pb) y),
cen AS (SELECT cluster_id AS cl, {", ".join(f"avg({c}) AS c_{c}" for c in FEATS)} FROM lf GROUP BY 1),
dist AS (SELECT lf.customer_unique_id, lf.cluster_id, cen.cl,
                sqrt({" + ".join(f"pow(lf.{c} - cen.c_{c}, 2)" for c in FEATS)}) AS d
         FROM lf, cen),
conf AS (SELECT customer_unique_id, cluster_id, max(CASE WHEN cl = cluster_id THEN d END) AS own,
                min(CASE WHEN cl <> cluster_id THEN d END) AS second, min(d) AS lo, max(d) AS hi
         FROM dist GROUP BY 1, 2),
rp AS (SELECT c.customer_unique_id, c.cluster_id, p.persona, c.own AS distance_to_center,
              least(greatest(1.0 - c.own / greatest(c.second, 1e-10), 0.0), 1.0) AS confidence_score,
              CASE WHEN c.hi > c.lo THEN 1.0 - (c.own - c.lo) / (c.hi - c.lo) ELSE 1.0 END AS range_confidence
       FROM conf c JOIN pers p ON c.cluster_id = p.cluster_id),
rs AS (SELECT customer_unique_id, max(segment) AS segment, CAST(sum(total_sales_amount) AS DOUBLE) AS revenue,
              count(DISTINCT order_id) AS orders FROM fact GROUP BY 1)"""


def ssql(body: str):
    return lambda p: with_base(body, p, _cust_ctes(p))


# --- I1-I7 -----------------------------------------------------------------------------------------
@register("i1_customer_aggregates", ssql("SELECT * FROM ca"))
def i1(ctx):
    return S.customer_aggregates(ctx.enriched)


@register("i2_behaviour_features", ssql("SELECT * FROM cf"))
def i2(ctx):
    return features(ctx)


@register("i3_feature_validation", ssql(f"""
SELECT count(*) AS customers, count(*) FILTER (WHERE recency_days < 0) AS negative_recency,
       count(*) FILTER (WHERE total_revenue < 0) AS negative_revenue,
       count(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in FEATS)}) AS rows_with_nulls,
       count(*) - count(DISTINCT customer_unique_id) AS duplicate_customers FROM cf"""))
def i3(ctx):
    return S.feature_validation(features(ctx))


@register("i4_rfm_scores", ssql("SELECT * FROM rfm2"))
def i4(ctx):
    return rfm(ctx)


@register("i4_rfm_code_frequency", ssql("""
SELECT rfm_score, count(*) AS customers FROM rfm2 GROUP BY 1 ORDER BY customers DESC, rfm_score LIMIT 10"""))
def i4f(ctx):
    return S.rfm_code_frequency(rfm(ctx))


LOG_SQL = ", ".join(f"round(ln(1 + greatest(CAST({c} AS DOUBLE), 0.0)), 6) AS {c}" for c in FEATS)


@register("i5_log_features", ssql(f"SELECT customer_unique_id, {LOG_SQL} FROM cf"))
def i5(ctx):
    return rnd(S.log_features(features(ctx)), FEATS)


@register("i6_standard_scaled", ssql(f"""
SELECT customer_unique_id, {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, 6) AS {c}"
                                      for c in FEATS)}
FROM lf, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)} FROM lf) st"""))
def i6(ctx):
    return rnd(S.standard_scale(S.log_features(features(ctx))), FEATS)


@register("i6_robust_scaled", ssql(f"""
SELECT customer_unique_id,
       {", ".join(f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] > 0 THEN q_{c}[3] - q_{c}[1] ELSE 1.0 END, 6) AS {c}"
                  for c in FEATS)}
FROM lf, (SELECT {", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in FEATS)} FROM lf) st"""))
def i6r(ctx):
    return rnd(S.robust_scale(S.log_features(features(ctx))), FEATS)


_PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i:]]


@register("i7_correlation_matrix", ssql(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM lf" for a, b in _PAIRS)))
def i7(ctx):
    return rnd(S.correlation_matrix(S.log_features(features(ctx))), ["corr"])


# --- I14-I16 on rule labels ---------------------------------------------------------------------------
@register("i14_calinski_harabasz", ssql(f"""
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM
 (SELECT sum({" + ".join(f"pow(lf.{c} - cen.c_{c}, 2)" for c in FEATS)}) AS w FROM lf JOIN cen ON lf.cluster_id = cen.cl) a,
 (SELECT sum(nk * ({" + ".join(f"pow(c_{c} - g_{c}, 2)" for c in FEATS)})) AS b
  FROM (SELECT cen.*, (SELECT count(*) FROM lf WHERE lf.cluster_id = cen.cl) AS nk FROM cen) c,
       (SELECT {", ".join(f"avg({c}) AS g_{c}" for c in FEATS)} FROM lf) g) bb,
 (SELECT count(*) AS n, count(DISTINCT cluster_id) AS k FROM lf) nn"""))
def i14(ctx):
    pts = S.log_features(features(ctx)).join(rule_labels(ctx), "customer_unique_id")
    return rnd(S.calinski_harabasz(pts, FEATS), ["calinski_harabasz"])


@register("i15_davies_bouldin", ssql(f"""
SELECT round(avg(r), 6) AS davies_bouldin FROM (
  SELECT a.cl, max((a.s + b.s) / sqrt({" + ".join(f"pow(a.c_{c} - b.c_{c}, 2)" for c in FEATS)})) AS r
  FROM (SELECT cen.*, sc.s FROM cen JOIN (SELECT cluster_id, avg(sqrt({" + ".join(f"pow(lf.{c} - cen.c_{c}, 2)" for c in FEATS)})) AS s
                                         FROM lf JOIN cen ON lf.cluster_id = cen.cl GROUP BY 1) sc ON cen.cl = sc.cluster_id) a,
       (SELECT cen.*, sc.s FROM cen JOIN (SELECT cluster_id, avg(sqrt({" + ".join(f"pow(lf.{c} - cen.c_{c}, 2)" for c in FEATS)})) AS s
                                         FROM lf JOIN cen ON lf.cluster_id = cen.cl GROUP BY 1) sc ON cen.cl = sc.cluster_id) b
  WHERE a.cl <> b.cl GROUP BY a.cl) t"""))
def i15(ctx):
    pts = S.log_features(features(ctx)).join(rule_labels(ctx), "customer_unique_id")
    return rnd(S.davies_bouldin(pts, FEATS), ["davies_bouldin"])


@register("i16_adjusted_rand_index", ssql("""
SELECT round(CASE WHEN (sa + sb) / 2.0 - sa * sb / (n * (n - 1) / 2.0) = 0 THEN 1.0
             ELSE (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (n * (n - 1) / 2.0)) END, 6) AS ari
FROM (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n
      FROM (SELECT r_score, m_score, CAST(count(*) AS DOUBLE) AS nij FROM rfm GROUP BY 1, 2) t) x,
     (SELECT sum(a * (a - 1) / 2.0) AS sa FROM (SELECT CAST(count(*) AS DOUBLE) AS a FROM rfm GROUP BY r_score) t) y,
     (SELECT sum(b * (b - 1) / 2.0) AS sb FROM (SELECT CAST(count(*) AS DOUBLE) AS b FROM rfm GROUP BY m_score) t) z"""))
def i16(ctx):
    return rnd(S.adjusted_rand_index(rfm(ctx), "r_score", "m_score"), ["ari"])


# --- I17-I23 on rule labels ----------------------------------------------------------------------------
PROF_COLS = ["total_segment_revenue", "avg_recency", "avg_orders", "avg_revenue", "avg_aov", "avg_items",
             "avg_categories", "avg_freight", "pct_customers", "revenue_share_pct"]


@register("i17_cluster_profile", ssql(f"""
SELECT cluster_id, customer_count, round(total_segment_revenue, 2) AS total_segment_revenue,
       {", ".join(f"round({c}, 6) AS {c}" for c in PROF_COLS[1:])} FROM prof"""))
def i17(ctx):
    prof = S.cluster_profiles(features(ctx), rule_labels(ctx))
    return rnd(rnd(prof, PROF_COLS[1:]), ["total_segment_revenue"], 2)


@register("i18_i19_personas", ssql("SELECT cluster_id, persona FROM pers"))
def i18(ctx):
    return S.assign_personas(S.cluster_profiles(features(ctx), rule_labels(ctx))).select("cluster_id", "persona")


@register("i20_persona_details", ssql("""
SELECT persona, count(*) AS customer_count, round(sum(total_revenue), 2) AS total_revenue,
       round(avg(average_order_value), 6) AS avg_order_value
FROM cf JOIN rp ON cf.customer_unique_id = rp.customer_unique_id GROUP BY 1"""))
def i20(ctx):
    return rnd(rnd(S.persona_details(features(ctx), rule_personas(ctx)), ["avg_order_value"]), ["total_revenue"], 2)


@register("i21_persona_top_categories", ssql("""
SELECT persona, category, customers, rank FROM (
  SELECT persona, category, count(*) AS customers,
         CAST(row_number() OVER (PARTITION BY persona ORDER BY count(*) DESC, category) AS INTEGER) AS rank
  FROM (SELECT DISTINCT e.customer_unique_id, e.product_category_name_english AS category FROM enriched e
        WHERE e.product_category_name_english IS NOT NULL AND e.customer_unique_id IS NOT NULL) d
  JOIN rp ON d.customer_unique_id = rp.customer_unique_id GROUP BY 1, 2) t WHERE rank <= 5"""))
def i21(ctx):
    return S.persona_top_categories(ctx.enriched, rule_personas(ctx)).withColumn("rank", F.col("rank").cast("int"))


@register("i22_i23_assignment_confidence", ssql("""
SELECT customer_unique_id, cluster_id, persona, round(distance_to_center, 6) AS distance_to_center,
       round(confidence_score, 6) AS confidence_score, round(range_confidence, 6) AS range_confidence FROM rp"""))
def i22(ctx):
    return rnd(rule_personas(ctx), ["distance_to_center", "confidence_score", "range_confidence"])


# --- persona-dependent F / G queries (rule personas) -----------------------------------------------------
def _xtab(ctx) -> DataFrame:
    return rule_segments(ctx).join(rule_personas(ctx), "customer_unique_id", "left")


@register("f15_segment_persona_crosstab", ssql("""
SELECT rs.segment, rp.persona, count(*) AS customers, round(avg(rp.confidence_score), 6) AS avg_confidence,
       round(avg(rs.revenue), 6) AS avg_revenue, round(avg(rs.orders), 6) AS avg_orders
FROM rs LEFT JOIN rp ON rs.customer_unique_id = rp.customer_unique_id GROUP BY 1, 2"""))
def f15(ctx):
    x = _xtab(ctx).groupBy("segment", "persona").agg(
        F.count(F.lit(1)).cast("long").alias("customers"), F.avg("confidence_score").alias("avg_confidence"),
        F.avg("revenue").alias("avg_revenue"), F.avg("orders").alias("avg_orders"))
    return rnd(x, ["avg_confidence", "avg_revenue", "avg_orders"])


@register("f20_customer_segment_lookup", ssql("""
SELECT rs.customer_unique_id, rp.persona, rp.cluster_id, round(rp.confidence_score, 6) AS confidence_score,
       rs.revenue, rs.orders FROM rs LEFT JOIN rp ON rs.customer_unique_id = rp.customer_unique_id
WHERE rs.customer_unique_id = '7'"""))
def f20(ctx):
    x = _xtab(ctx).where(F.col("customer_unique_id") == "7")
    return rnd(x.select("customer_unique_id", "persona", "cluster_id", "confidence_score", "revenue", "orders"),
               ["confidence_score"])


@register("f22_segmentation_overview", ssql("""
SELECT count(*) AS customers, count(DISTINCT cluster_id) AS clusters, count(DISTINCT persona) AS personas FROM rp"""))
def f22(ctx):
    return rule_personas(ctx).agg(F.count(F.lit(1)).cast("long").alias("customers"),
                                  F.countDistinct("cluster_id").cast("long").alias("clusters"),
                                  F.countDistinct("persona").cast("long").alias("personas"))


XT = """xt AS (SELECT rs.segment, rp.persona, count(*) AS n, sum(rp.confidence_score) AS conf_sum,
                  sum(rs.revenue) AS revenue
           FROM rs JOIN rp ON rs.customer_unique_id = rp.customer_unique_id GROUP BY 1, 2)"""


def xsql(body: str):
    return lambda p: with_base(body, p, _cust_ctes(p) + ",\n" + XT)


def _cells(ctx) -> DataFrame:
    j = rule_segments(ctx).join(rule_personas(ctx), "customer_unique_id")
    return j.groupBy("segment", "persona").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("confidence_score").alias("conf_sum"),
                                               F.sum("revenue").alias("revenue"))


@register("g7_crosstab_shares", xsql("""
SELECT segment, persona, n AS customers, round(n * 100.0 / sum(n) OVER (PARTITION BY persona), 6) AS share_of_persona,
       round(n * 100.0 / sum(n) OVER (PARTITION BY segment), 6) AS share_of_segment FROM xt"""))
def g7(ctx):
    c = _cells(ctx)   # segments x personas: bounded (3 x K)
    return rnd(c.select("segment", "persona", F.col("n").cast("long").alias("customers"),
                        (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("persona"))).alias("share_of_persona"),
                        (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("segment"))).alias("share_of_segment")),
               ["share_of_persona", "share_of_segment"])


def _dominant(c: DataFrame, key: str, other: str, prefix: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(other))
    tot = Window.partitionBy(key)
    return (c.withColumn("_r", F.row_number().over(w)).withColumn("_size", F.sum("n").over(tot))
             .withColumn("_conf", F.sum("conf_sum").over(tot) / F.sum("n").over(tot))
             .where("_r = 1")
             .select(key, F.col(other).alias(f"dominant_{prefix}"),
                     (F.col("n") * 100.0 / F.col("_size")).alias("dominant_share"),
                     F.col("_conf").alias("avg_confidence"), F.col("_size").cast("long").alias("customers")))


def _dominant_sql(key: str, other: str, prefix: str) -> str:
    return f"""
SELECT {key}, {other} AS dominant_{prefix}, round(n * 100.0 / size, 6) AS dominant_share,
       round(conf / size, 6) AS avg_confidence, CAST(size AS BIGINT) AS customers
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {other}) AS r,
             sum(n) OVER (PARTITION BY {key}) AS size, sum(conf_sum) OVER (PARTITION BY {key}) AS conf FROM xt) t
WHERE r = 1"""


@register("g8_persona_coherence", xsql(_dominant_sql("persona", "segment", "segment")))
def g8(ctx):
    return rnd(_dominant(_cells(ctx), "persona", "segment", "segment"), ["dominant_share", "avg_confidence"])


@register("g9_segment_composition", xsql(_dominant_sql("segment", "persona", "persona")))
def g9(ctx):
    return rnd(_dominant(_cells(ctx), "segment", "persona", "persona"), ["dominant_share", "avg_confidence"])


@register("g10_overall_agreement", xsql("""
SELECT round(sum(CASE WHEN xt.segment = d.dom THEN xt.n ELSE 0 END) * 100.0 / sum(xt.n), 6) AS agreement_pct
FROM xt JOIN (SELECT persona, segment AS dom FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY n DESC, segment) AS r
                                                  FROM xt) q WHERE r = 1) d ON xt.persona = d.persona"""))
def g10(ctx):
    c = _cells(ctx)
    d = _dominant(c, "persona", "segment", "segment").select("persona", F.col("dominant_segment").alias("_dom"))
    j = c.join(F.broadcast(d), "persona")   # one row per persona
    return rnd(j.agg((F.sum(F.when(F.col("segment") == F.col("_dom"), F.col("n")).otherwise(0)) * 100.0
                      / F.sum("n")).alias("agreement_pct")), ["agreement_pct"])


# cohort -> persona markers; the two actionable ones are the first with 'new' and the second with 'vip'
COHORT_MARKERS = {"value_persona": ("VIP", "High-Value"), "dormant_persona": ("Dormant", "Churned", "Inactive")}
ACTIONABLE = (("value_persona", "new"), ("dormant_persona", "vip"))
ALL_COHORTS = tuple((k, seg) for k in COHORT_MARKERS for seg in ("new", "repeat", "vip"))


def _cohorts_sql(cohorts) -> str:
    parts = "\n  UNION ALL ".join(
        f"""SELECT '{k}_{seg}_rule' AS cohort, CAST(sum(n) AS BIGINT) AS customers, sum(revenue) / sum(n) AS avg_revenue
  FROM xt WHERE ({" OR ".join(f"persona LIKE '%{m}%'" for m in COHORT_MARKERS[k])}) AND segment = '{seg}'"""
        for k, seg in cohorts)
    return f"SELECT cohort, customers, round(avg_revenue, 6) AS avg_revenue FROM (\n  {parts}) t WHERE customers > 0"


def _cohorts(ctx, cohorts):
    c = _cells(ctx)
    parts = []
    for k, seg in cohorts:
        has = reduce(lambda a, b: a | b, [F.col("persona").contains(m) for m in COHORT_MARKERS[k]])
        parts.append(c.where(has & (F.col("segment") == seg))
                     .agg(F.sum("n").cast("long").alias("customers"), (F.sum("revenue") / F.sum("n")).alias("avg_revenue"))
                     .select(F.lit(f"{k}_{seg}_rule").alias("cohort"), "customers", "avg_revenue"))
    return rnd(reduce(lambda a, b: a.unionByName(b), parts).where(F.col("customers") > 0), ["avg_revenue"])


@register("g11_actionable_cohorts", xsql(_cohorts_sql(ACTIONABLE)))
def g11(ctx):
    return _cohorts(ctx, ACTIONABLE)


@register("g11_cohorts_all_segments", xsql(_cohorts_sql(ALL_COHORTS)))
def g11_all(ctx):
    return _cohorts(ctx, ALL_COHORTS)


# every name the persona rule can produce: the pivot's fixed column list
PIVOT_PERSONAS = S.PERSONAS + [f"{S.PERSONAS[0]} (Core)"] + [f"{x} (Long-Term)" for x in S.PERSONAS[1:]]


def _pivot_sql(p: Params) -> str:
    cols = ", ".join(f"CAST(COALESCE(sum(n) FILTER (WHERE persona = '{x}'), 0) AS BIGINT) AS " + '"' + x + '"'
                     for x in PIVOT_PERSONAS)
    return with_base(f"SELECT segment, {cols} FROM xt GROUP BY 1", p, _cust_ctes(p) + ",\n" + XT)


@register("g12_crosstab_pivot", _pivot_sql)
def g12(ctx):
    c = _cells(ctx)
    return (c.groupBy("segment").pivot("persona", PIVOT_PERSONAS).agg(F.sum("n"))
             .select("segment", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(x)
                                  for x in PIVOT_PERSONAS]))


@register("g14_risk_value_counts", ssql(f"""
SELECT CAST(sum(customer_count) FILTER (WHERE {" OR ".join(f"persona LIKE '%{m}%'" for m in S.AT_RISK_MARKERS)}) AS BIGINT) AS at_risk,
       CAST(COALESCE(sum(customer_count) FILTER (WHERE persona LIKE '%VIP%'), 0) AS BIGINT) AS vip,
       CAST(COALESCE(sum(customer_count) FILTER (WHERE persona LIKE '%High-Value Spenders%'), 0) AS BIGINT) AS high_value,
       CAST(sum(customer_count) AS BIGINT) AS cluster_total,
       round(COALESCE(sum(customer_count) FILTER (WHERE {" OR ".join(f"persona LIKE '%{m}%'" for m in S.AT_RISK_MARKERS)}), 0)
             / sum(customer_count), 6) AS at_risk_ratio
FROM pers"""))
def g14(ctx):
    prof = S.assign_personas(S.cluster_profiles(features(ctx), rule_labels(ctx)))
    risk = reduce(lambda a, b: a | b, [F.col("persona").contains(m) for m in S.AT_RISK_MARKERS])
    out = prof.agg(F.sum(F.when(risk, F.col("customer_count"))).alias("at_risk"),
                   F.coalesce(F.sum(F.when(F.col("persona").contains("VIP"), F.col("customer_count"))), F.lit(0))
                   .cast("long").alias("vip"),
                   F.coalesce(F.sum(F.when(F.col("persona").contains("High-Value Spenders"), F.col("customer_count"))),
                              F.lit(0)).cast("long").alias("high_value"),
                   F.sum("customer_count").alias("cluster_total"))
    out = out.withColumn("at_risk_ratio", F.coalesce(F.col("at_risk"), F.lit(0)) / F.col("cluster_total"))
    return rnd(out.select(F.col("at_risk").cast("long"), "vip", "high_value", F.col("cluster_total").cast("long"),
                          "at_risk_ratio"), ["at_risk_ratio"])


def _health_sql(above: float) -> str:
    risk = " OR ".join(f"persona LIKE '%{m}%'" for m in S.AT_RISK_MARKERS)
    return f"""
SELECT CAST(sum(customer_count) FILTER (WHERE {risk}) AS BIGINT) AS at_risk, CAST(sum(customer_count) AS BIGINT) AS cluster_total,
       round(COALESCE(sum(customer_count) FILTER (WHERE {risk}), 0) / sum(customer_count) * 100.0, 4) AS at_risk_pct,
       CASE WHEN COALESCE(sum(customer_count) FILTER (WHERE {risk}), 0) / sum(customer_count) > {above} OR r.repeat_pct < 5
            THEN 'warning' WHEN r.repeat_pct > 20 THEN 'positive' ELSE 'neutral' END AS customer_sentiment,
       COALESCE(sum(customer_count) FILTER (WHERE {risk}), 0) / sum(customer_count) > {above} AS at_risk_flag
FROM pers, (SELECT 100.0 * count(*) FILTER (WHERE n > 1) / count(*) AS repeat_pct
            FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM fact GROUP BY 1) c) r
GROUP BY r.repeat_pct"""


def _health(ctx, above: float):
    from ..operators import dashboard as D
    from ..operators import insights as G
    from ..functions.filters import Slice
    snap = D.customer_snapshot(ctx, Slice())
    repeat = snap.select((F.col("repeat_customers") * 100.0 / F.col("total_customers"))).scalar()
    return rnd(G.customer_health(g14(ctx), repeat, above), ["at_risk_pct"], 4)


@register("g15_g16_customer_health", ssql(_health_sql(0.4)))
def g15_health(ctx):
    return _health(ctx, 0.4)


@register("g16_customer_health_low_threshold", ssql(_health_sql(0.05)))
def g16_health(ctx):
    """The same rule with a threshold that the fixture's customers exceed."""
    return _health(ctx, 0.05)


def _risks_sql(p: Params) -> str:
    from .q_insights import _blocks
    risk = " OR ".join(f"persona LIKE '%{m}%'" for m in S.AT_RISK_MARKERS)
    row = "SELECT 'summary' AS domain, 'risk' AS type, 'warning' AS severity, '{0}' AS metric, {1} AS subject, round({0}, 4) AS value FROM {2}"
    parts = [row.format("repeat_pct", "CAST(NULL AS VARCHAR)", "rowk WHERE repeat_pct < 101 AND total_customers > 0"),
             row.format("top_category_share", "top_category", "rowk WHERE top_category_share > 1"),
             row.format("top_state_share", "top_state", "rowk WHERE top_state_share > 1"),
             row.format("at_risk_pct", "CAST(NULL AS VARCHAR)", f"""(
               SELECT COALESCE(sum(customer_count) FILTER (WHERE {risk}), 0) / sum(customer_count) * 100.0 AS at_risk_pct
               FROM pers) h WHERE at_risk_pct > 5""")]
    return with_base(" UNION ALL ".join(parts), p, _blocks(p) + ",\n" + _cust_ctes(p))


@register("g16_risks_with_customers", _risks_sql)
def g16_rows(ctx):
    """Limits that the fixture passes: a row for each of the four risks."""
    from ..functions.filters import Slice
    from ..operators import insights as G
    out = G.risk_flags(G.kpi_row(ctx, Slice(), ctx.params), _health(ctx, 0.05), repeat_below=101.0, share_above=1.0)
    return rnd(out, ["value"], 4)


@register("g23_cluster_revenue_share", ssql("""
SELECT cluster_id, persona, round(total_segment_revenue, 2) AS revenue,
       round(total_segment_revenue / sum(total_segment_revenue) OVER () * 100.0, 6) AS revenue_share_pct FROM pers"""))
def g23(ctx):
    prof = S.assign_personas(S.cluster_profiles(features(ctx), rule_labels(ctx)))
    return rnd(prof.select("cluster_id", "persona", F.col("total_segment_revenue").alias("revenue"),
                           (F.col("total_segment_revenue") / F.sum("total_segment_revenue").over(Window.partitionBy())
                            * 100.0).alias("revenue_share_pct")), ["revenue_share_pct"]).withColumn(
        "revenue", F.round("revenue", 2))


# --- I10, I13, I24 on rule labels ---------------------------------------------------------------------------
RULES = {"m": "m_score", "r": "r_score", "f": "f_score"}


def _ruled_points(ctx) -> DataFrame:
    """customer, its log features as an array, and three rule labellings."""
    def build():
        x = F.array(*[F.col(c) for c in FEATS]).alias("x")
        labels = rfm(ctx).select("customer_unique_id", *[F.col(c).alias(n) for n, c in RULES.items()])
        return ctx._store(S.log_features(features(ctx)).select("customer_unique_id", x).join(labels, "customer_unique_id"),
                          "ruled_points")
    return ctx.memo("ruled_points", build)


#: Rows of the evaluation sample in the checked queries; the SQL twin holds each against each.
CHECKED_ROWS = S.clustering.EVALUATION_ROWS
SAMPLE_SQL = f"""
, sm AS (SELECT lf.* FROM lf ORDER BY md5('{S.SEED}:' || lf.customer_unique_id), lf.customer_unique_id LIMIT {CHECKED_ROWS})"""


@register("i10_evaluation_sample", ssql(SAMPLE_SQL + " SELECT customer_unique_id FROM sm"))
def i10(ctx):
    return S.clustering.evaluation_sample(features(ctx).select("customer_unique_id"), "customer_unique_id", CHECKED_ROWS, S.SEED)


_SQUARED = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEATS)
_OF_RULES = f"""
, lr AS (SELECT lf.*, u.labelling, CASE u.labelling WHEN 'm' THEN m_score WHEN 'r' THEN r_score ELSE f_score END AS l
         FROM lf JOIN rfm ON lf.customer_unique_id = rfm.customer_unique_id,
              (SELECT unnest(['m', 'r', 'f']) AS labelling) u),
cr AS (SELECT labelling, l, count(*) AS nk, {", ".join(f"avg({c}) AS {c}" for c in FEATS)} FROM lr GROUP BY 1, 2),
gr AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in FEATS)} FROM lf),
wr AS (SELECT a.labelling, a.l, sum({_SQUARED}) AS w, avg(sqrt({_SQUARED})) AS s
       FROM lr a JOIN cr b ON a.labelling = b.labelling AND a.l = b.l GROUP BY 1, 2),
chr_ AS (SELECT a.labelling, count(*) AS k, sum(nk) AS n, sum(nk * ({_SQUARED})) AS bb, sum(w.w) AS ww
         FROM cr a JOIN wr w ON a.labelling = w.labelling AND a.l = w.l, gr b GROUP BY 1),
dbr AS (SELECT labelling, avg(r) AS db FROM (
          SELECT a.labelling, a.l, max((wa.s + wb.s) / sqrt({_SQUARED})) AS r
          FROM cr a JOIN cr b ON a.labelling = b.labelling AND a.l <> b.l
               JOIN wr wa ON a.labelling = wa.labelling AND a.l = wa.l
               JOIN wr wb ON b.labelling = wb.labelling AND b.l = wb.l GROUP BY 1, 2) t GROUP BY 1),
sl AS (SELECT sm.*, u.labelling, CASE u.labelling WHEN 'm' THEN m_score WHEN 'r' THEN r_score ELSE f_score END AS l
       FROM sm JOIN rfm ON sm.customer_unique_id = rfm.customer_unique_id, (SELECT unnest(['m', 'r', 'f']) AS labelling) u),
ds AS (SELECT a.labelling, a.customer_unique_id AS id, a.l, b.l AS other, sum(sqrt({_SQUARED})) AS t, count(*) AS n
       FROM sl a JOIN sl b ON a.labelling = b.labelling GROUP BY 1, 2, 3, 4),
sc AS (SELECT labelling, id, max(CASE WHEN other = l THEN n END) AS own,
              max(CASE WHEN other = l THEN t / greatest(n - 1, 1) END) AS a, min(CASE WHEN other <> l THEN t / n END) AS b
       FROM ds GROUP BY 1, 2),
sil AS (SELECT labelling, avg(CASE WHEN own < 2 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
        FROM sc WHERE b IS NOT NULL GROUP BY 1)"""


@register("i13_i24_measures_of_rule_labels", ssql(SAMPLE_SQL + _OF_RULES + """
SELECT c.labelling, c.k AS clusters, round(silhouette, 6) AS silhouette,
       round((bb / (k - 1)) / (ww / (n - k)), 4) AS calinski_harabasz, round(db, 6) AS davies_bouldin
FROM chr_ c LEFT JOIN dbr ON c.labelling = dbr.labelling LEFT JOIN sil ON c.labelling = sil.labelling"""))
def i13_rules(ctx):
    """Silhouette, CH and DB of three labellings of the same customers, judged together."""
    out = S.clustering.judge(_ruled_points(ctx), "customer_unique_id", "x", list(RULES), CHECKED_ROWS, S.SEED)
    return rnd(rnd(out, ["silhouette", "davies_bouldin"]), ["calinski_harabasz"], 4)


# --- model path (rows check) -------------------------------------------------------------------------------
def _scaled_pca(ctx):
    def build():
        logf = S.log_features(features(ctx))
        out = {}
        for name, fn in (("StandardScaler", S.standard_scale), ("RobustScaler", S.robust_scale)):
            vec = S.to_vector(ctx._store(fn(logf), f"scaled_{name}"))
            out[name] = S.pca_85(vec)
        return out
    return ctx.memo("scaled_pca", build)


def _points(ctx) -> DataFrame:
    """customer and its principal components, an array per scaler."""
    def build():
        parts = [p.select("customer_unique_id", F.col("pca").alias(name)) for name, (p, _, _) in _scaled_pca(ctx).items()]
        return ctx._store(reduce(lambda a, b: a.join(b, "customer_unique_id"), parts), "cluster_points")
    return ctx.memo("cluster_points", build)


def _sweep(ctx) -> S.Sweep:
    return ctx.memo("k_sweep", lambda: S.k_sweep(_points(ctx), ctx._store))


def _chosen(ctx):
    """(scaler, K, its centres, the customers with cluster_id)."""
    sweep = _sweep(ctx)
    best = sweep.table.where("chosen").first()
    s, k = best["scaler"], best["k"]
    labelled = sweep.labels[s].select("customer_unique_id", s, F.col(S.label_name("kmeans", k)).alias("cluster_id"))
    return s, k, sweep.centres[s, k], labelled


@register("i8_pca_85")
def i8(ctx):
    rows = []
    for name, (_, k, ratios) in _scaled_pca(ctx).items():
        cum = 0.0
        for i, r in enumerate(ratios):
            cum += r
            rows.append((name, i + 1, r, cum, i < k))
    return ctx.spark.createDataFrame(rows, "scaler string, component int, explained double, cumulative double, selected boolean")


@register("i9_projection_2d")
def i9(ctx):
    return S.projection_2d(S.to_vector(S.standard_scale(S.log_features(features(ctx)))),
                           _chosen(ctx)[3].select("customer_unique_id", "cluster_id"))


@register("i11_k_sweep")
def i11(ctx):
    return _sweep(ctx).table


@register("i12_kmeans_assignments")
def i12(ctx):
    return _chosen(ctx)[3].select("customer_unique_id", "cluster_id")


@register("i13_silhouette")
def i13(ctx):
    return _sweep(ctx).table.where("chosen").select("scaler", "k", "silhouette")


@register("i16_kmeans_stability")
def i16k(ctx):
    s, k, _, labelled = _chosen(ctx)
    refits = S.stability_labels(_points(ctx), s, k)
    both = ctx._store(refits.drop(s).join(labelled.select("customer_unique_id", "cluster_id"), "customer_unique_id"),
                      "stability_labels")
    return reduce(lambda a, b: a.unionByName(b), [
        S.adjusted_rand_index(both, "cluster_id", f"seed_{seed}").select(F.lit(seed).alias("seed"), "ari")
        for seed in S.STABILITY_SEEDS])


@register("i12_kmeans_personas")
def i12p(ctx):
    return S.assign_personas(S.cluster_profiles(features(ctx), i12(ctx)))


@register("i22_kmeans_confidence")
def i22k(ctx):
    s, _, centres, labelled = _chosen(ctx)
    x = [F.get(s, F.lit(i)).alias(f"_c{i}") for i in range(centres.shape[1])]
    points = labelled.select("customer_unique_id", "cluster_id", *x)
    return (S.assignment_confidence(points, centres.tolist(), cols=[f"_c{i}" for i in range(centres.shape[1])])
            .select("customer_unique_id", "cluster_id", "distance_to_center", "confidence_score"))


@register("i24_gmm_comparison")
def i24(ctx):
    return S.algorithm_comparison(_points(ctx), _sweep(ctx), ctx._store)


@register("g15_model_sentiment")
def g15m(ctx):
    """G15 (model part): silhouette sentiment (0.5 / 0.25) of the K-Means fit and
    R^2 sentiment (0.8 / 0.5) of the best random forest on the test split."""
    from ..operators import forecasting as FC
    from ..operators import insights as G
    from ..operators import timeseries as T
    from . import q_timeseries as QT
    sil = _sweep(ctx).table.where("chosen").select("silhouette").scalar()
    data, _ = QT._prepared(ctx)
    rf = QT._searched(ctx)["random_forest"][0]
    met = T.regression_metrics(FC.predict(rf.model, data.where("split = 'test'"), "random_forest"), by=["model"])
    return (met.select("model", "r2", sil.alias("silhouette"))
               .withColumn("forecast_sentiment", G.score_sentiment(F.col("r2"), 0.8, 0.5))
               .withColumn("segmentation_sentiment", G.score_sentiment(F.col("silhouette"), 0.5, 0.25)))
