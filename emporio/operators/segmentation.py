"""Customer features, RFM scores, clustering, cluster quality, personas.

Customer-grain work is ordinary grouping of the fact (partial aggregates
per task, then one shuffle on customer_unique_id).  Per-cluster work runs
over K rows (K <= 8), so joins against cluster centres / profiles are
broadcasts of a frame whose size is bounded by K.  K-Means and the
measures of labellings are in ``clustering``; GaussianMixture and PCA come
from pyspark.ml.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..functions.quantiles import exact_quantiles
from . import clustering

SEED = 42
# Fixed values of the clustering recipe.
CLUSTERING_FEATURES = ["recency_days", "number_of_orders", "total_revenue", "average_order_value",
                       "total_items_purchased", "unique_categories", "avg_freight", "items_per_order",
                       "category_diversity_ratio", "freight_revenue_ratio", "customer_tenure_days"]
K_RANGE = list(range(2, 9))
MIN_ACTIONABLE_SEGMENTS = 4
PERSONAS = ["VIP Loyalists", "Churned High-Value", "High-Value Spenders", "Dormant / Inactive",
            "Standard / Bargain Shoppers"]
AT_RISK_MARKERS = ["Churned", "Dormant", "At-Risk", "Inactive"]

# initialisations of a K-Means configuration
STARTS = 10
# seeds of the refits whose agreement is measured (own choice)
STABILITY_SEEDS = [0, 7, 21, 99, 123]


# --- I1 / I2 / I3 ---------------------------------------------------------------------------
def customer_aggregates(enriched: DataFrame) -> DataFrame:
    """Customer -> orders, revenue, mean item value, items, distinct products and
    categories, mean freight, first / last purchase day, state."""
    f = enriched.where(F.col("customer_unique_id").isNotNull())
    # sums by place first: the greatest of strings would sort all items, and measures beside
    # the distinct counts would go through a fourth copy of each item
    places = f.groupBy("customer_unique_id", "state_code").agg(
        F.sum("total_sales_amount").alias("revenue"), F.count("total_sales_amount").alias("priced"),
        F.sum("quantity").alias("items"), F.sum("freight_value").alias("freight"), F.count("freight_value").alias("sent"),
        F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    sums = (places.groupBy("customer_unique_id")
            .agg(F.sum("revenue").cast("double").alias("total_revenue"),
                 (F.sum("revenue").cast("double") / F.sum("priced")).alias("average_order_value"),
                 F.sum("items").cast("long").alias("total_items_purchased"),
                 (F.sum("freight").cast("double") / F.sum("sent")).alias("avg_freight"),
                 F.min("first").alias("first_purchase_date"), F.max("last").alias("last_purchase_date"),
                 F.coalesce(F.max("state_code"), F.lit("UNKNOWN")).alias("customer_state")))
    # one distinct count at a time: together they need a copy of the items for each, held by one partial aggregate
    counted = {"number_of_orders": "order_id", "unique_products": "product_id",
               "unique_categories": "product_category_name_english"}
    for name, col in counted.items():
        sums = sums.join(f.groupBy("customer_unique_id").agg(F.countDistinct(col).cast("long").alias(name)), "customer_unique_id")
    return sums.select("customer_unique_id", "number_of_orders", "total_revenue", "average_order_value",
                       "total_items_purchased", "unique_products", "unique_categories", "avg_freight",
                       "first_purchase_date", "last_purchase_date", "customer_state")


def behaviour_features(cust: DataFrame, params: Params) -> DataFrame:
    ref = F.lit(params.rfm_reference_date).cast("date")
    orders = F.col("number_of_orders")
    items = F.col("total_items_purchased")
    tenure = F.datediff("last_purchase_date", "first_purchase_date")
    return cust.withColumns({
        "recency_days": F.datediff(ref, F.col("last_purchase_date")),
        "customer_tenure_days": tenure,
        "items_per_order": items / orders,
        "category_diversity_ratio": F.col("unique_categories") / items,
        "product_diversity_ratio": F.col("unique_products") / items,
        "freight_revenue_ratio": F.col("avg_freight") / F.greatest(F.col("average_order_value"), F.lit(1.0)),
        "avg_purchase_interval_days": tenure / F.greatest(orders.cast("double"), F.lit(1.0)),
    })


def feature_validation(features: DataFrame) -> DataFrame:
    """Negative recency / revenue, NULL features, duplicated customers (one row)."""
    return features.agg(
        F.count(F.lit(1)).cast("long").alias("customers"),
        F.count_if(F.col("recency_days") < 0).cast("long").alias("negative_recency"),
        F.count_if(F.col("total_revenue") < 0).cast("long").alias("negative_revenue"),
        F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in CLUSTERING_FEATURES]))
        .cast("long").alias("rows_with_nulls"),
        (F.count(F.lit(1)) - F.countDistinct("customer_unique_id")).cast("long").alias("duplicate_customers"))


# --- I4 ---------------------------------------------------------------------------------------
QUINTILES = [0.2, 0.4, 0.6, 0.8]


def quintile_edges(df: DataFrame, cols: list[str]) -> Column:
    """Inner quintile edges (20/40/60/80 %) of the columns, exact: a struct of arrays, from one pass for all of them."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("s")).select("s.*")
    q = exact_quantiles(long, "x", QUINTILES, group="column")

    def edge(c, p):
        return F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("value")))

    return q.agg(F.struct(*[F.array(*[edge(c, p) for p in QUINTILES]).alias(c) for c in cols])).scalar()


def _bin(x: Column, edges: Column) -> Column:
    """1..5: right-closed quintile bins, lowest value in bin 1 (``edges``: array of 4)."""
    return (F.lit(1) + reduce(lambda a, b: a + b,
                              [(x > edges[i]).cast("int") for i in range(4)])).cast("int")


def rfm_scores(features: DataFrame) -> DataFrame:
    """R: recency quintile reversed (5 = most recent); F: order-count bins
    (0,1] (1,2] (2,5] (5,100] -> 1..4, else 1; M: revenue quintile."""
    # the edges are one scalar subquery (two arrays of four), not a joined frame
    edges = quintile_edges(features, ["recency_days", "total_revenue"])
    r, m = edges["recency_days"], edges["total_revenue"]
    n = F.col("number_of_orders")
    f_score = (F.when((n > 0) & (n <= 1), 1).when((n > 1) & (n <= 2), 2).when((n > 2) & (n <= 5), 3)
                .when((n > 5) & (n <= 100), 4).otherwise(1))
    out = features.select("customer_unique_id", "recency_days", "number_of_orders", "total_revenue",
                          (F.lit(6) - _bin(F.col("recency_days"), r)).alias("r_score"),
                          f_score.cast("int").alias("f_score"), _bin(F.col("total_revenue"), m).alias("m_score"))
    return out.withColumn("rfm_score", F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                                                F.col("m_score").cast("string")))


def rfm_code_frequency(scores: DataFrame, n: int = 10) -> DataFrame:
    return (scores.groupBy("rfm_score").agg(F.count(F.lit(1)).cast("long").alias("customers"))
                  .orderBy(F.desc("customers"), F.asc("rfm_score")).limit(n))


# --- I5 / I6 / I7 -------------------------------------------------------------------------------
def log_features(features: DataFrame, cols=CLUSTERING_FEATURES) -> DataFrame:
    """log1p(max(0, x))."""
    return features.select("customer_unique_id",
                           *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols])


def standard_scale(df: DataFrame, cols=CLUSTERING_FEATURES) -> DataFrame:
    """I6 standard: (x - mean) / population std (0 std -> 1)."""
    st = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                         *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])).scalar()   # one scalar subquery
    return df.select("customer_unique_id", *[
        ((F.col(c) - st[f"m_{c}"]) / F.when(st[f"s_{c}"] > 0, st[f"s_{c}"]).otherwise(F.lit(1.0)))
        .alias(c) for c in cols])


def robust_scale(df: DataFrame, cols=CLUSTERING_FEATURES) -> DataFrame:
    """I6 robust: (x - median) / IQR (0 IQR -> 1), exact quantiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("s")).select("s.*")
    q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], group="column")   # one pass for all columns

    def at(c, p):
        return F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("value")))

    st = q.agg(F.struct(*[s for c in cols for s in (at(c, 0.5).alias(f"med_{c}"),
                                                    (at(c, 0.75) - at(c, 0.25)).alias(f"iqr_{c}"))])).scalar()
    return df.select("customer_unique_id", *[
        ((F.col(c) - st[f"med_{c}"]) / F.when(st[f"iqr_{c}"] > 0, st[f"iqr_{c}"]).otherwise(F.lit(1.0))).alias(c)
        for c in cols])


def correlation_matrix(df: DataFrame, cols=CLUSTERING_FEATURES) -> DataFrame:
    """Pearson correlation of every feature pair, long form, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}__{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", "__").getItem(0).alias("feature_a"),
                       F.split("pair", "__").getItem(1).alias("feature_b"), "corr")


# --- I8 / I9 / I10 --------------------------------------------------------------------------------
def to_vector(df: DataFrame, cols=CLUSTERING_FEATURES, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def pca_85(vectors: DataFrame, threshold: float = 0.85, in_col: str = "features"):
    """I8: components until cumulative explained variance >= threshold, from one fit.

    Returns (frame with ``pca``, an array of the first k components, k, explained ratios)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    n = len(vectors.select(in_col).first()[0])
    model = PCA(k=n, inputCol=in_col, outputCol="_all").fit(vectors)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    cum, k = 0.0, n
    for i, r in enumerate(ratios):
        cum += r
        if cum >= threshold:
            k = i + 1
            break
    projected = model.transform(vectors).withColumn("pca", F.slice(vector_to_array("_all"), 1, k)).drop("_all")
    return projected, k, ratios


def projection_2d(vectors: DataFrame, labels: DataFrame | None = None, in_col: str = "features") -> DataFrame:
    """Every customer; a caller that draws them samples for display."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    m = PCA(k=2, inputCol=in_col, outputCol="_p2").fit(vectors)
    p = m.transform(vectors).select("customer_unique_id", vector_to_array("_p2").alias("_a"))
    p = p.select("customer_unique_id", F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"))
    if labels is not None:
        p = p.join(labels, "customer_unique_id", "left")
    return p


# --- I11-I13 / I24 ----------------------------------------------------------------------------------
KEY = "customer_unique_id"


@dataclass
class Sweep:
    """Measures of every (scaler, K), the labels of every customer, and the centres behind them."""
    table: DataFrame
    labels: dict[str, DataFrame]
    centres: dict[tuple[str, int], np.ndarray]


def label_name(algorithm: str, k: int) -> str:
    return f"{algorithm}_{k}"


def k_sweep(points: DataFrame, store, k_range=K_RANGE, rows: int = clustering.EVALUATION_ROWS) -> Sweep:
    """Every (scaler, K) from ``STARTS`` starts: inertia, silhouette, CH, DB.

    ``points`` has the customer and an array column per scaler.  All
    configurations are fitted together; of each the start with the least
    inertia counts.  The chosen row has the best silhouette among
    K >= MIN_ACTIONABLE_SEGMENTS.  ``store(df, name)`` writes a table.
    """
    spark = points.sparkSession
    scalers = [c for c in points.columns if c != KEY]
    configs = [clustering.Config(s, k, start) for s in scalers for k in k_range for start in range(STARTS)]
    fits = clustering.fit_many(points, KEY, configs, seed=SEED)
    centres = clustering.best_starts(fits)
    inertia = {}
    for c, (_, w) in fits.items():
        inertia[c.space, c.k] = min(w, inertia.get((c.space, c.k), w))
    labels, judged = {}, []
    for s in scalers:
        names = {label_name("kmeans", k): centres[s, k] for k in k_range}
        labels[s] = store(clustering.assign(points.select(KEY, s), s, names), f"kmeans_labels_{s}")
        judged.append(clustering.judge(labels[s], KEY, s, list(names), rows, SEED).withColumn("scaler", F.lit(s)))
    costs = spark.createDataFrame([(s, k, float(w)) for (s, k), w in inertia.items()], "scaler string, k int, inertia double")
    found = (reduce(lambda a, b: a.unionByName(b), judged)
             .withColumn("k", F.element_at(F.split("labelling", "_"), -1).cast("int")).join(costs, ["scaler", "k"]))
    # a row per configuration
    order = Window.orderBy(F.when(F.col("k") >= MIN_ACTIONABLE_SEGMENTS, F.col("silhouette")).desc_nulls_last(), "scaler", "k")
    chosen = (F.row_number().over(order) == 1) & (F.col("k") >= MIN_ACTIONABLE_SEGMENTS)
    table = store(found.select("scaler", "k", "silhouette", "calinski_harabasz", "davies_bouldin", "inertia",
                               chosen.alias("chosen")), "k_sweep")
    return Sweep(table, labels, centres)


def algorithm_comparison(points: DataFrame, sweep: Sweep, store, k_range=range(3, 9),
                         rows: int = clustering.EVALUATION_ROWS) -> DataFrame:
    """Gaussian mixtures against K-Means for every scaler and K: silhouette, CH, DB.

    All mixtures start as Spark's GaussianMixture does and are fitted
    together.  The labels of all models of a scaler are judged together.  A mixture
    whose components are partly empty is judged by the others;
    ``clusters`` says how many there are, and one alone has no measures.
    """
    from pyspark.ml.functions import array_to_vector
    out, starts = [], {}
    for s in sweep.labels:
        vectors = store(points.select(KEY, array_to_vector(s).alias("features")), f"gmm_points_{s}")
        starts |= {(s, k): clustering.mixture_start(vectors, k, SEED) for k in k_range}
    mixtures = clustering.fit_mixtures(points, starts)
    for s, labelled in sweep.labels.items():
        names = [label_name(a, k) for a in ("kmeans", "gmm") for k in k_range]
        both = clustering.assign_mixtures(labelled, s, {label_name("gmm", k): mixtures[s, k] for k in k_range})
        both = store(both, f"algorithm_labels_{s}")
        out.append(clustering.judge(both, KEY, s, names, rows, SEED).withColumn("scaler", F.lit(s)))
    found = reduce(lambda a, b: a.unionByName(b), out)
    part = F.split("labelling", "_")
    return found.select("scaler", part[0].alias("algorithm"), part[1].cast("int").alias("k"), "clusters", "silhouette",
                        "calinski_harabasz", "davies_bouldin")


def stability_labels(points: DataFrame, space: str, k: int, seeds=tuple(STABILITY_SEEDS)) -> DataFrame:
    """I16: a labelling ``seed_<s>`` per seed, each the best of ``STARTS`` starts, fitted on all customers."""
    centres = {}
    for s in seeds:
        fits = clustering.fit_many(points, KEY, [clustering.Config(space, k, n) for n in range(STARTS)], seed=s)
        centres[f"seed_{s}"] = clustering.best_starts(fits)[space, k]
    return clustering.assign(points.select(KEY, space), space, centres)


# --- I14 / I15 / I16: quality of any labelling --------------------------------------------------------
def _long(points: DataFrame, cols: list[str], label: str) -> DataFrame:
    return points.select(F.col(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("dim"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)]))
        .alias("s")).select("label", "s.dim", "s.x")


def centroids(points: DataFrame, cols: list[str], label: str = "cluster_id") -> DataFrame:
    """(label, dim, c) -- K x d rows."""
    return _long(points, cols, label).groupBy("label", "dim").agg(F.avg("x").alias("c"))


def _measure(points: DataFrame, cols: list[str], label: str, name: str) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in cols])
    return clustering.dispersion(points.select(x.alias("x"), label), "x", [label]).select(name)


def calinski_harabasz(points: DataFrame, cols: list[str], label: str = "cluster_id") -> DataFrame:
    """[B / (k - 1)] / [W / (n - k)] (one row)."""
    return _measure(points, cols, label, "calinski_harabasz")


def davies_bouldin(points: DataFrame, cols: list[str], label: str = "cluster_id") -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j) (one row)."""
    return _measure(points, cols, label, "davies_bouldin")


def adjusted_rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """I16: ARI of two labellings from their contingency table (one row)."""
    comb2 = lambda c: c * (c - 1) / 2.0
    cont = labels.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("nij"))
    sum_ij = cont.agg(F.sum(comb2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    sa = cont.groupBy(a).agg(F.sum("nij").alias("ai")).agg(F.sum(comb2(F.col("ai"))).alias("sa"))
    sb = cont.groupBy(b).agg(F.sum("nij").alias("bj")).agg(F.sum(comb2(F.col("bj"))).alias("sb"))
    j = sum_ij.crossJoin(sa).crossJoin(sb)   # three one-row aggregates
    expected = F.col("sa") * F.col("sb") / comb2(F.col("n"))
    max_index = (F.col("sa") + F.col("sb")) / 2.0
    return j.select(F.when(max_index - expected == 0, F.lit(1.0))
                     .otherwise((F.col("sij") - expected) / (max_index - expected)).alias("ari"))


# --- I17-I21 ---------------------------------------------------------------------------------------------
def cluster_profiles(features: DataFrame, labels: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Per cluster size, revenue, averages and shares."""
    j = features.join(labels, "customer_unique_id")
    prof = j.groupBy(label).agg(
        F.count(F.lit(1)).cast("long").alias("customer_count"),
        F.sum("total_revenue").alias("total_segment_revenue"),
        F.avg("recency_days").alias("avg_recency"), F.avg("number_of_orders").alias("avg_orders"),
        F.avg("total_revenue").alias("avg_revenue"), F.avg("average_order_value").alias("avg_aov"),
        F.avg("total_items_purchased").alias("avg_items"), F.avg("unique_categories").alias("avg_categories"),
        F.avg("avg_freight").alias("avg_freight"))
    tot = Window.partitionBy()    # K rows
    return (prof.withColumn("pct_customers", F.col("customer_count") / F.sum("customer_count").over(tot) * 100.0)
                .withColumn("revenue_share_pct",
                            F.col("total_segment_revenue") / F.sum("total_segment_revenue").over(tot) * 100.0))


def assign_personas(profiles: DataFrame, label: str = "cluster_id") -> DataFrame:
    """I18 + I19: value / repeat / lapse axes -> five names; duplicates split by lapse."""
    tot = Window.partitionBy()    # K rows
    p = (profiles
         .withColumn("_portfolio_avg", F.sum("total_segment_revenue").over(tot) / F.sum("customer_count").over(tot))
         .withColumn("_rec_med", F.percentile("avg_recency", 0.5).over(tot))
         .withColumn("_rep_thr", F.percentile("avg_orders", 0.5).over(tot) + 0.5))
    high_value = F.col("avg_revenue") >= F.col("_portfolio_avg")
    repeat = F.col("avg_orders") > F.col("_rep_thr")
    lapsed = F.col("avg_recency") > F.col("_rec_med")
    base = (F.when(repeat & high_value, PERSONAS[0]).when(high_value & lapsed, PERSONAS[1])
             .when(high_value, PERSONAS[2]).when(lapsed, PERSONAS[3]).otherwise(PERSONAS[4]))
    p = p.withColumn("_base", base)
    w = Window.partitionBy("_base").orderBy(F.desc("avg_recency"), F.asc(label))
    rn = F.row_number().over(w)
    name = (F.when(rn == 1, F.col("_base"))
             .when(F.col("_base") == PERSONAS[0], F.concat(F.col("_base"), F.lit(" (Core)")))
             .otherwise(F.concat(F.col("_base"), F.lit(" (Long-Term)"))))
    return p.withColumn("persona", name).drop("_portfolio_avg", "_rec_med", "_rep_thr", "_base")


def persona_details(features: DataFrame, personas: DataFrame) -> DataFrame:
    """Customers, revenue and average AOV per persona."""
    j = features.join(personas, "customer_unique_id")
    return j.groupBy("persona").agg(F.count(F.lit(1)).cast("long").alias("customer_count"),
                                    F.sum("total_revenue").alias("total_revenue"),
                                    F.avg("average_order_value").alias("avg_order_value"))


def persona_top_categories(enriched: DataFrame, personas: DataFrame, n: int = 5) -> DataFrame:
    """The n categories bought by most customers of each persona."""
    d = (enriched.where(F.col("product_category_name_english").isNotNull() & F.col("customer_unique_id").isNotNull())
                 .select("customer_unique_id", F.col("product_category_name_english").alias("category")).distinct()
                 .join(personas.select("customer_unique_id", "persona"), "customer_unique_id"))
    c = d.groupBy("persona", "category").agg(F.count(F.lit(1)).cast("long").alias("customers"))
    w = Window.partitionBy("persona").orderBy(F.desc("customers"), F.asc("category"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- I22 / I23 ----------------------------------------------------------------------------------------
def assignment_confidence(points: DataFrame, centers: list[list[float]], cols: list[str] | None = None,
                          vec_col: str | None = None, label: str = "cluster_id") -> DataFrame:
    """I22 + I23: distance to own centre, to the nearest other, margin confidence
    clip(1 - own / max(second, 1e-10), 0, 1) and range-normalised confidence.

    ``centers`` is K x d numbers (the model's centres) -- a literal of bounded size.
    """
    from pyspark.ml.functions import vector_to_array
    if vec_col:
        x = vector_to_array(F.col(vec_col))
        comps = [x[i] for i in range(len(centers[0]))]
    else:
        comps = [F.col(c).cast("double") for c in cols]
    dists = [F.sqrt(reduce(lambda a, b: a + b, [F.pow(comps[i] - F.lit(float(c[i])), 2)
                                                for i in range(len(c))])) for c in centers]
    arr = F.array(*dists)
    p = points.withColumn("_d", arr)
    own = F.element_at(F.col("_d"), F.col(label).cast("int") + 1)
    others = F.filter(F.transform(F.col("_d"), lambda v, i: F.when(i != F.col(label), v)), lambda v: v.isNotNull())
    second = F.array_min(others)
    lo, hi = F.array_min(F.col("_d")), F.array_max(F.col("_d"))
    margin = F.least(F.greatest(F.lit(1.0) - own / F.greatest(second, F.lit(1e-10)), F.lit(0.0)), F.lit(1.0))
    return (p.withColumn("distance_to_center", own).withColumn("second_distance", second)
             .withColumn("confidence_score", margin)
             .withColumn("range_confidence", F.when(hi > lo, F.lit(1.0) - (own - lo) / (hi - lo)).otherwise(F.lit(1.0)))
             .drop("_d"))
