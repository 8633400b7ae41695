"""Incremental append load (A5) with Structured Streaming.

New order-item files landing in a folder are picked up by a file-source
stream; each micro-batch is joined to the orders known by then and
appended to the fact folder.  The stream's checkpoint records which files
were processed, and every batch writes to its own ``batch_id=<n>``
sub-folders with overwrite semantics, so a batch replayed after a failure
replaces its own output instead of duplicating rows (exactly-once for the
folder as a whole).

An item whose order isn't known yet waits: batch n writes the items
without an order to ``waiting/batch_id=<n>`` and batch n + 1 takes them
up again together with its own.  A replay of batch n reads what batch
n - 1 left, which no later batch changes.  Only unmatched items are kept,
each as long as its order is missing.

The reference has no real-time requirement; this is its append load
expressed so a cluster can run it continuously or as an
``availableNow`` catch-up job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import warehouse as W
from ..sources.schemas import ORDER_ITEMS


def _waiting(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    try:
        return spark.read.schema(ORDER_ITEMS).parquet(f"{folder}/batch_id={batch_id}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":   # nothing waits before the first batch
            raise
        return spark.createDataFrame([], ORDER_ITEMS)


def append_batch(items: DataFrame, batch_id: int, orders: DataFrame, out_dir: str, waiting_dir: str) -> None:
    """One micro-batch: items with a known order go to the fact, the others wait for the next batch."""
    spark = items.sparkSession
    fields = ORDER_ITEMS.names
    every = items.select(*fields).unionByName(_waiting(spark, waiting_dir, batch_id - 1).select(*fields))
    known = orders.select("order_id", "customer_id", "order_purchase_timestamp")
    ts = F.try_to_timestamp("order_purchase_timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    matched = (W.measures(every).join(known, "order_id")
               .withColumn("purchase_date_key", F.date_format(ts, "yyyyMMdd").cast("int")).drop("order_purchase_timestamp"))
    # an item without an order number can't be matched later either, and waits visibly
    unmatched = every.join(known.select("order_id"), "order_id", "left_anti").select(*fields)
    unmatched.write.mode("overwrite").parquet(f"{waiting_dir}/batch_id={batch_id}")
    matched.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")


def start_item_append(spark: SparkSession, items_dir: str, orders: DataFrame | Callable[[], DataFrame], out_dir: str,
                      checkpoint_dir: str, fmt: str = "parquet", available_now: bool = True,
                      max_files_per_trigger: int | None = None, waiting_dir: str | None = None):
    """Start the stream; returns the StreamingQuery (``awaitTermination`` for a catch-up run).

    ``orders`` is a table, or a function that reads the orders known when a batch runs.
    """
    reader = spark.readStream.schema(ORDER_ITEMS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    items = reader.load(items_dir)
    waiting = (waiting_dir or f"{checkpoint_dir.rstrip('/')}-waiting").rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, orders() if callable(orders) else orders, out_dir, waiting)

    w = items.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
