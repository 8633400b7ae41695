"""Data-quality checks and reconciliation.

Every check returns a small DataFrame of findings -- typically
``(check, dataset, key, violations, status)`` -- computed with one
aggregate pass (``count_if``), an anti join, or a group-by; nothing is
collected to the driver.  ``raise_on_failure`` turns a findings frame
into an exception for runs that must stop, as the reference's ETL does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, WARN = "PASS", "FAIL", "WARN"


def _status(bad: Column, level: str = FAIL) -> Column:
    return F.when(bad, F.lit(level)).otherwise(F.lit(PASS))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- C1 / C2 -----------------------------------------------------------------------------
def schema_check(spark, frames: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Required columns present?  Metadata only (no scan)."""
    rows = []
    for name, cols in required.items():
        have = set(frames[name].columns) if name in frames else set()
        missing = sorted(set(cols) - have)
        rows.append(("schema", name, ",".join(missing), len(missing), PASS if not missing else FAIL))
    return spark.createDataFrame(rows, "check string, dataset string, key string, violations long, status string")


def row_count_check(df: DataFrame, expected: DataFrame, dataset: str) -> DataFrame:
    """Row count of ``df`` against a one-row frame holding ``expected``."""
    actual = df.agg(F.count(F.lit(1)).alias("actual"))
    return (actual.crossJoin(expected)                    # two one-row frames
            .select(F.lit("row_count").alias("check"), F.lit(dataset).alias("dataset"),
                    F.col("expected").cast("long").alias("expected"), F.col("actual").cast("long").alias("actual"),
                    F.abs(F.col("actual") - F.col("expected")).cast("long").alias("violations"),
                    _status(F.col("actual") != F.col("expected")).alias("status")))


# --- C3 / C10 / D5 ---------------------------------------------------------------------------
def duplicated_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once, with their counts (GROUP BY .. HAVING)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def grain_check(df: DataFrame, keys: list[str], dataset: str) -> DataFrame:
    """Rows belonging to duplicated key groups (every member counts)."""
    d = duplicated_groups(df, keys)
    return (d.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("violations"),
                  F.count(F.lit(1)).cast("long").alias("duplicate_keys"))
             .select(F.lit("grain").alias("check"), F.lit(dataset).alias("dataset"),
                     F.lit(",".join(keys)).alias("key"), "violations", "duplicate_keys",
                     _status(F.col("violations") > 0).alias("status")))


# --- C4 / C5 ----------------------------------------------------------------------------------
def null_key_check(df: DataFrame, keys: list[str], dataset: str, allow: bool = True) -> DataFrame:
    """Per key column, number of NULLs (orphans); WARN when allowed, else FAIL."""
    counts = df.agg(*[F.count_if(F.col(k).isNull()).cast("long").alias(k) for k in keys])
    long = counts.unpivot([], keys, "key", "violations")
    return long.select(F.lit("null_keys").alias("check"), F.lit(dataset).alias("dataset"), "key",
                       "violations", _status(F.col("violations") > 0, WARN if allow else FAIL).alias("status"))


def business_rules(fact: DataFrame, dataset: str = "fact_sales") -> DataFrame:
    rules = {
        "price_non_negative": F.col("price") < 0,
        "freight_non_negative": F.col("freight_value") < 0,
        "total_non_negative": F.col("total_sales_amount") < 0,
        "quantity_positive": F.col("quantity") <= 0,
    }
    counts = fact.agg(*[F.count_if(c).cast("long").alias(k) for k, c in rules.items()])
    return (counts.unpivot([], list(rules), "key", "violations")
            .select(F.lit("business_rule").alias("check"), F.lit(dataset).alias("dataset"), "key",
                    "violations", _status(F.col("violations") > 0).alias("status")))


# --- C6 ---------------------------------------------------------------------------------------
def revenue_reconciliation(source_items: DataFrame, fact: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """abs(sum(source) - sum(fact)) <= tolerance, for price and freight."""
    s = source_items.agg(F.sum("price").alias("src_price"), F.sum("freight_value").alias("src_freight"))
    f = fact.agg(F.sum("price").alias("fact_price"), F.sum("freight_value").alias("fact_freight"))
    j = s.crossJoin(f)                                      # two one-row frames
    rows = [j.select(F.lit(m).alias("measure"), F.col(f"src_{m}").cast("double").alias("source_total"),
                     F.col(f"fact_{m}").cast("double").alias("fact_total"),
                     F.abs(F.col(f"src_{m}") - F.col(f"fact_{m}")).cast("double").alias("difference"))
            for m in ("price", "freight")]
    return (_union(rows).withColumn("status", _status(F.col("difference") > tolerance)))


# --- C7 / C8 / C14 / C15 ------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None,
            check: str = "orphans", dataset: str = "", skip_null: bool = False) -> DataFrame:
    """Child rows whose key has no parent row (anti join) -> one-row count."""
    parent_key = parent_key or child_key
    c = child.where(F.col(child_key).isNotNull()) if skip_null else child
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    anti = c.join(p, c[child_key] == p["_pk"], "left_anti")
    return (anti.agg(F.count(F.lit(1)).cast("long").alias("violations"))
            .select(F.lit(check).alias("check"), F.lit(dataset).alias("dataset"),
                    F.lit(child_key).alias("key"), "violations",
                    _status(F.col("violations") > 0, WARN).alias("status")))


def orphan_drilldown(child: DataFrame, parent: DataFrame, key: str, parent_key: str,
                     show: list[str]) -> DataFrame:
    """Distinct locations of orphan rows, sorted (semi join back to the source)."""
    missing = (child.select(key).where(F.col(key).isNotNull()).distinct()
               .join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti"))
    return child.join(missing, key, "left_semi").select(*show).distinct().orderBy(*show)


def match_rate(child: DataFrame, matched_flag: Column, loaded: DataFrame) -> DataFrame:
    """Processed, loaded, matched, missing and success % of a dimension lookup."""
    a = child.agg(F.count(F.lit(1)).alias("processed"), F.count_if(matched_flag).alias("matched"))
    b = loaded.agg(F.count(F.lit(1)).alias("loaded"))
    return (a.crossJoin(b)   # two one-row aggregates
            .select(F.col("processed").cast("long"), F.col("loaded").cast("long"),
                    F.col("matched").cast("long"),
                    (F.col("processed") - F.col("matched")).cast("long").alias("missing"),
                    F.when(F.col("processed") > 0, F.col("matched") * 100.0 / F.col("processed"))
                    .otherwise(F.lit(0.0)).alias("success_pct")))


# --- C9 / C11 / C12 ------------------------------------------------------------------------------
def row_count_rollcall(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).cast("long").alias("row_count"))
                     .select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def warehouse_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.countDistinct("order_id").cast("long").alias("distinct_orders"),
        F.sum("price").cast("double").alias("total_price"),
        F.sum("freight_value").cast("double").alias("total_freight"),
        F.sum("total_sales_amount").cast("double").alias("total_sales"),
        (F.sum("price").cast("double") / F.count("price")).alias("avg_price"),
        (F.sum("freight_value").cast("double") / F.count("freight_value")).alias("avg_freight"),
        (F.sum("total_sales_amount").cast("double") / F.count("total_sales_amount")).alias("avg_sales"))


def warehouse_kpis(fact: DataFrame) -> DataFrame:
    """C11 plus distinct customers, sellers, products and AOV."""
    t = fact.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.countDistinct("order_id").cast("long").alias("distinct_orders"),
        F.countDistinct("customer_unique_id").cast("long").alias("distinct_customers"),
        F.countDistinct("seller_id").cast("long").alias("distinct_sellers"),
        F.countDistinct("product_id").cast("long").alias("distinct_products"),
        F.sum("total_sales_amount").cast("double").alias("total_sales"))
    return t.withColumn("average_order_value",
                        F.when(F.col("distinct_orders") > 0, F.col("total_sales") / F.col("distinct_orders"))
                        .otherwise(F.lit(0.0)))


# --- C13 ---------------------------------------------------------------------------------------------
def reporting_audit(table: DataFrame, name: str, key: str, revenue_col: str, fact: DataFrame,
                    fact_revenue: str = "total_sales_amount", orders_col: str | None = None,
                    fact_orders: DataFrame | None = None, tolerance: float = 0.1) -> DataFrame:
    """Audit one reporting table against the fact.

    Checks: not empty, no NULL key, no duplicate key, revenue total within
    ``tolerance`` of the fact, no negative revenue, and -- only where the
    distinct count is additive over the key -- order totals equal.
    """
    t = table.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col(key).isNull()).alias("null_keys"),
                  (F.count(F.lit(1)) - F.countDistinct(key)).alias("dup_keys"),
                  F.sum(F.col(revenue_col).cast("decimal(28,2)")).cast("double").alias("rev"),   # cents add up exactly
                  F.count_if(F.col(revenue_col) < 0).alias("neg_rev"),
                  *( [F.sum(orders_col).alias("orders")] if orders_col else []))
    f = fact.agg(F.sum(fact_revenue).cast("double").alias("fact_rev"),
                 *( [F.countDistinct("order_id").alias("fact_orders")] if orders_col else []))
    j = t.crossJoin(f)                                      # two one-row frames
    checks = [
        ("not_empty", (F.col("rows") == 0).cast("long"), F.col("rows") == 0),
        ("null_key", F.col("null_keys"), F.col("null_keys") > 0),
        ("duplicate_key", F.col("dup_keys"), F.col("dup_keys") > 0),
        ("revenue_matches_fact", F.abs(F.col("rev") - F.col("fact_rev")),
         F.abs(F.col("rev") - F.col("fact_rev")) > tolerance),
        ("no_negative_revenue", F.col("neg_rev"), F.col("neg_rev") > 0),
    ]
    if orders_col:
        checks.append(("orders_match_fact", F.abs(F.col("orders") - F.col("fact_orders")),
                       F.col("orders") != F.col("fact_orders")))
    return _union([j.select(F.lit(name).alias("table_name"), F.lit(c).alias("check"),
                            v.cast("double").alias("value"), _status(bad).alias("status"))
                   for c, v, bad in checks])


def raise_on_failure(findings: DataFrame) -> None:
    """Stop a run when any finding has status FAIL (one small action)."""
    by = [c for c in ("table_name", "check") if c in findings.columns]
    bad = findings.where(F.col("status") == FAIL).groupBy(*by).agg(F.count(F.lit(1)).alias("failures")).collect()
    if any(r["failures"] for r in bad):
        raise ValueError(f"data-quality failures: {[r.asDict() for r in bad]}")
