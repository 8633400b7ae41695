"""Per-dataset context: sources, parameters and the shared fact tables.

``Context.enriched`` is the item-grain fact every reporting and ML job
reads.  By default it is materialised once per session and dataset as
Parquet under ``spark.checkpoint.dir`` (shared storage on a cluster), so
later jobs start from a written table: lineage stays short, a lost
executor only costs the tasks of the job that was running, and Catalyst
still prunes columns / pushes filters into the Parquet scan.
Set ``materialize=False`` for a purely lazy plan.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..functions.order_rows import order_rows
from ..operators import cubes
from ..operators import warehouse as wh
from ..session import ensure_checkpoint_dir
from ..sources.fixture import load_fixture_sources

_LOCK = threading.Lock()
_MEMO: dict = {}


class Context:
    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame], params: Params,
                 name: str, materialize: bool = True):
        self.spark = spark
        self.src = sources
        self.params = params
        self.name = name
        self.materialize = materialize
        self._enriched = None
        self._orders = None
        self._keyed = None
        self._lock = threading.RLock()
        self._memo: dict = {}

    # --- construction -----------------------------------------------------------
    @staticmethod
    def for_fixture(spark: SparkSession, sf_dir: str, params: Params | None = None,
                    materialize: bool = True) -> "Context":
        params = params or Params.for_fixture()
        key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), params, materialize)
        with _LOCK:
            ctx = _MEMO.get(key)
            if ctx is None:
                ctx = Context(spark, load_fixture_sources(spark, sf_dir), params,
                              name=os.path.abspath(sf_dir), materialize=materialize)
                _MEMO[key] = ctx
        return ctx

    # --- shared tables ---------------------------------------------------------------
    def memo(self, key: str, build):
        """Build a shared table once per context (thread-safe): queries running in
        parallel never write the same stored table twice."""
        with self._lock:
            if key not in self._memo:
                self._memo[key] = build()
            return self._memo[key]

    def _store(self, df: DataFrame, label: str) -> DataFrame:
        if not self.materialize:
            return df
        base = ensure_checkpoint_dir(self.spark)
        # one folder per application: concurrent sessions never overwrite each other
        app = self.spark.sparkContext.applicationId
        digest = hashlib.sha1(f"{app}|{self.name}|{self.params}".encode()).hexdigest()[:12]
        path = f"{base.rstrip('/')}/emporio-tables/{label}-{digest}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def scratch(self, label: str) -> str:
        """A folder for tables a query writes and reads back (same place as ``_store``)."""
        base = ensure_checkpoint_dir(self.spark)
        app = self.spark.sparkContext.applicationId
        digest = hashlib.sha1(f"{app}|{self.name}|{self.params}".encode()).hexdigest()[:12]
        return f"{base.rstrip('/')}/emporio-tables/scratch-{digest}/{label}"

    @property
    def enriched(self) -> DataFrame:
        """Item-grain fact with nullable dimension attributes."""
        with self._lock:
            return self._enriched_locked()

    def _enriched_locked(self) -> DataFrame:
        if self._enriched is None:
            self._enriched = self._store(wh.enriched_fact(self.src, self.params, self._store), "enriched_fact")
        return self._enriched

    @property
    def keyed_dims(self) -> dict[str, DataFrame]:
        """Dimensions with dense surrogate keys (B6), pinned by checkpoints."""
        with self._lock:
            if self._keyed is None:
                self._keyed = wh.keyed_dimensions(self.src)
            return self._keyed

    @property
    def fact(self) -> DataFrame:
        """Denormalised fact (B13): attributes defaulted to 'unknown'."""
        return wh.denormalize(self.enriched)

    @property
    def single_orders(self) -> bool:
        """No order or customer id comes twice, so all items of an order take the same from it."""
        def unique(name, key):
            ids = self.src[name].where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            return ids.where("n > 1").isEmpty()
        return self.memo("single_orders", lambda: unique("customers", "customer_id") and unique("orders", "order_id"))

    def cube(self, name: str) -> DataFrame:
        """A stored summary table of ``operators.cubes``, built when it is first asked for."""
        build = cubes.NAMES[name].build
        if name == "orders":   # stored under ``orders`` already
            return build(self)
        return self.memo(f"cube_{name}", lambda: self._store(build(self), f"cube_{name}"))

    @property
    def orders(self) -> DataFrame:
        """Order grain (E17): one row per order, additive measures.

        An order has one customer, hence one segment and state, and one
        purchase month, so distinct order counts become row counts.
        """
        with self._lock:
            return self._orders_locked()

    def _orders_locked(self) -> DataFrame:
        if self._orders is None:
            same = ["customer_unique_id", "segment", "state_code", "month_year"]
            sums = {"revenue": F.sum("total_sales_amount"), "quantity": F.sum("quantity").cast("long"),
                    "freight": F.sum("freight_value")}
            self._orders = self._store(order_rows(self.fact, ["order_id"], same, sums, self.single_orders), "exec_orders")
        return self._orders
