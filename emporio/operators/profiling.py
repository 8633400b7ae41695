"""Source profiling as single-pass aggregates.

Per-column statistics are computed for all columns in one ``agg`` (one
scan) and turned into long form with ``unpivot``; nothing is computed
per column on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def dataset_profile(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns, NULL cells, duplicate rows (one row)."""
    cols = df.columns
    nulls = df.agg(F.count(F.lit(1)).alias("rows"),
                   *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    total_nulls = reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in range(len(cols))])
    distinct_rows = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return (nulls.crossJoin(distinct_rows)                   # two one-row frames
            .select(F.lit(name).alias("dataset"), F.col("rows").cast("long").alias("rows"),
                    F.lit(len(cols)).cast("long").alias("columns"),
                    total_nulls.cast("long").alias("missing_cells"),
                    (F.col("rows") - F.col("distinct_rows")).cast("long").alias("duplicate_rows")))


SAMPLES = 3


def column_values(df: DataFrame) -> DataFrame:
    """The distinct values of every column as text: (column_name, value), NULLs left out.

    Rows are unpivoted and equal values of a column combined before the
    shuffle, so a distinct count is a row count and no column needs a
    copy of all rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def value_samples(values: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(column_name, sample_values): of each column the first distinct values in hash order.

    A ranked limit per column: every task passes on ``samples`` rows of a
    column at most.
    """
    order = Window.partitionBy("column_name").orderBy(F.md5("value"), "value")
    few = values.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= samples)
    parts = F.array_sort(F.collect_list(F.struct("_r", "value")))     # ``samples`` elements
    return few.groupBy("column_name").agg(F.array_join(parts.getField("value"), " | ").alias("sample_values"))


def column_profile(df: DataFrame, name: str, samples: int = 0) -> DataFrame:
    """Per column type, NULLs, distinct values, min and max (as text), and ``samples`` values if asked for."""
    cols = df.columns
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).cast("long").alias(f"n{i}"),
                 F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = df.agg(F.count(F.lit(1)).cast("long").alias("rows"), *aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"), F.col(f"n{i}").alias("null_count"),
                        F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")) for i, c in enumerate(cols)]
    found = one.select("rows", F.explode(F.array(*structs)).alias("s")).select("s.*", "rows")     # a row per column
    values = column_values(df)
    distinct = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    out = (found.join(distinct, "column_name", "left")
           .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)).cast("long")))
    more = []
    if samples:
        out, more = out.join(value_samples(values, samples), "column_name", "left"), ["sample_values"]
    return out.select(F.lit(name).alias("dataset"), "column_name", "dtype", "null_count", "distinct_count", "min_value",
                      "max_value", *more, "rows")


def all_dataset_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """D3: D1 for every source."""
    return _union([dataset_profile(df, n) for n, df in frames.items()])


def missing_pct(frames: dict[str, DataFrame]) -> DataFrame:
    """NULL share per (dataset, column), largest first."""
    parts = []
    for name, df in frames.items():
        cols = df.columns
        one = df.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
        parts.append(one.unpivot(["rows"], cols, "column_name", "null_count")
                        .select(F.lit(name).alias("dataset"), "column_name", "null_count",
                                F.when(F.col("rows") > 0,
                                       F.col("null_count").cast("double") * 100.0 / F.col("rows").cast("double"))
                                .otherwise(F.lit(0.0)).alias("missing_pct")))
    return _union(parts).orderBy(F.desc("missing_pct"), "dataset", "column_name")


def value_distribution(df: DataFrame, col: str, attribute: str | None = None) -> DataFrame:
    """Counts per value."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("count"))
              .select(F.lit(attribute or col).alias("attribute"), "value", "count"))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """describe() with exact quartiles: count, nulls, mean, std, min, 25/50/75 %, max."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("s")).select("s.*")
    quartiles = exact_quantiles(long, "x", [0.25, 0.5, 0.75], group="column_name")   # one pass for all columns
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        base = df.agg(F.count(x).cast("long").alias("count"), F.count_if(x.isNull()).cast("long").alias("nulls"),
                      (F.sum(F.col(c)).cast("double") / F.count(x)).alias("mean"),
                      F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        qrow = quartiles.where(F.col("column_name") == c).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                       for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
        # base and qrow are one-row aggregates
        parts.append(base.crossJoin(qrow).select(F.lit(c).alias("column_name"), "count", "nulls", "mean",
                                                 "std", "min", "p25", "p50", "p75", "max"))
    return _union(parts)


def date_range(df: DataFrame, col: str) -> DataFrame:
    """D9."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def cardinality_ratio(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct customers (people), distinct orders, orders per customer."""
    c = customers.agg(F.countDistinct("customer_unique_id").cast("long").alias("distinct_customers"))
    o = orders.agg(F.countDistinct("order_id").cast("long").alias("distinct_orders"))
    return (c.crossJoin(o).withColumn(   # two one-row aggregates
        "orders_per_customer",
        F.when(F.col("distinct_customers") > 0,
               F.col("distinct_orders").cast("double") / F.col("distinct_customers").cast("double"))))


def domain_rules(items: DataFrame, reviews: DataFrame, payments: DataFrame) -> DataFrame:
    """Do all rows satisfy the value domains?"""
    i = items.agg(F.coalesce(F.every(F.col("price") >= 0), F.lit(True)).alias("price_non_negative"),
                  F.coalesce(F.every(F.col("freight_value") >= 0), F.lit(True)).alias("freight_non_negative"))
    r = reviews.agg(F.coalesce(F.every(F.col("review_score").between(1, 5)), F.lit(True))
                    .alias("score_in_range"))
    p = payments.agg(F.coalesce(F.every(F.col("payment_value") > 0), F.lit(True)).alias("payment_positive"))
    return (i.crossJoin(r).crossJoin(p)   # three one-row aggregates
            .withColumn("all_pass", F.col("price_non_negative") & F.col("freight_non_negative")
                        & F.col("score_in_range") & F.col("payment_positive")))
