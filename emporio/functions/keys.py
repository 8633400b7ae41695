"""Surrogate keys (B6) without a single-partition window.

``row_number().over(Window.orderBy(k))`` moves the whole table into one
task.  ``with_dense_key`` gives the same 1..N numbering in key order in
a distributed way: range-sort, pin the result with a reliable checkpoint
(so a recomputed partition gets the same ids), count rows per partition,
and add each partition's running offset (a frame with one row per
partition, so its size is bounded by the partition count).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def with_dense_key(df: DataFrame, order_cols: list[str | Column], key: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    cols = df.columns
    # persisted before the sort, whose sampling would read the input twice, and after it, as an
    # eager checkpoint runs the sort twice (once for its count, once to write the files)
    once = df.persist(StorageLevel.MEMORY_AND_DISK)
    ordered = once.orderBy(*order_cols).persist(StorageLevel.MEMORY_AND_DISK)
    fixed = ordered.checkpoint(eager=True)
    ordered.unpersist()
    once.unpersist()
    tagged = fixed.select("*", F.spark_partition_id().alias("_pid"),
                          F.monotonically_increasing_id().alias("_mid"))
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offsets = per_part.select(
        "_pid", "_m0",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .select(*[F.col(c) for c in cols],
                    (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).alias(key)))


def with_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Unique (not dense) 64-bit key for fact rows; never compared across runs.

    Stable under partition recomputation as long as the input partition
    is deterministic (the fact is written right after this step).
    """
    return df.withColumn(key, F.monotonically_increasing_id())
