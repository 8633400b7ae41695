"""Exact quantiles (linear interpolation) on value counts.

``percentile`` as a global aggregate keeps every distinct value of the
column in one task's buffer.  Here equal values are counted first, with
map-side combining, so a value that nearly all rows share is one row.
The distinct values are range-sorted across the cluster; running counts
come from per-partition sums and offsets (one row per partition and
group).  A quantile is the value whose interval of positions holds it,
picked by a partial aggregate.  One pass serves all groups, so several
columns are asked for together by unpivoting them into (column, value).

Same definition as numpy / DuckDB ``quantile_cont``:
    h = p * (n - 1);  q = x[floor h] + (h - floor h) * (x[ceil h] - x[floor h])
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, col: str, probs: list[float], group: str | None = None) -> DataFrame:
    """One row per probability: (p, value) -- or (group, p, value) with ``group``; NULLs are ignored."""
    ensure_checkpoint_dir(df.sparkSession)
    key = F.col(group) if group else F.lit(0)
    counts = (df.select(key.alias("_g"), F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
              .groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")))
    # persisted first: an eager checkpoint otherwise computes the sort twice
    spread = counts.orderBy("_g", "_v").persist(StorageLevel.MEMORY_AND_DISK)
    fixed = spread.checkpoint(eager=True)
    spread.unpersist()
    tagged = fixed.withColumn("_pid", F.spark_partition_id())
    runs = tagged.groupBy("_g", "_pid").agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("_g", "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"),
                          F.sum("_s").over(Window.partitionBy("_g")).alias("_n"))
    upto = Window.partitionBy("_g", "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (tagged.withColumn("_run", F.sum("_c").over(upto)).join(offsets, ["_g", "_pid"])
              .select("_g", "_v", "_n", (F.col("_off") + F.col("_run") - F.col("_c")).alias("_from"),
                      (F.col("_off") + F.col("_run")).alias("_to")))

    def at(position):
        return F.max(F.when((F.col("_from") <= position) & (position < F.col("_to")), F.col("_v")))

    picks = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        picks.append(F.struct(F.lit(float(p)).alias("p"), low.alias("low"), high.alias("high"),
                              F.max(h - F.floor(h)).alias("part")))
    out = placed.groupBy("_g").agg(F.array(*picks).alias("_q")).select("_g", F.inline("_q"))
    return out.select(*([F.col("_g").alias(group)] if group else []), "p",
                      (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value"))


def quantile_row(df: DataFrame, col: str, probs: list[float], prefix: str = "q") -> DataFrame:
    """The quantiles of ``exact_quantiles`` pivoted into one row (one column per p)."""
    q = exact_quantiles(df, col, probs)
    return q.agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"{prefix}{i}")
                   for i, p in enumerate(probs)])
