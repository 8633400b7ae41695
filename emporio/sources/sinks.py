"""A3-A10: table reads and writes, paged reads, exports, stage metrics.

Tables are Parquet folders (or catalog tables when a name without '/' is
given).  Writes are whole-table overwrites or appends done by the
executors; row counts come from ``Observation`` on the write itself, so
no second pass over the data is needed.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Tables a paged report may read, with their sort keys.
REPORT_TABLES = {
    "reporting_sales_summary": ["order_month"],
    "reporting_category_summary": ["product_category"],
    "reporting_state_summary": ["state_code"],
    "reporting_customer_summary": ["customer_unique_id"],
    "reporting_seller_summary": ["seller_id"],
}
MAX_PAGE_SIZE = 500


def _is_path(target: str) -> bool:
    return "/" in target or target.startswith(".")


# --- A3 ----------------------------------------------------------------------------------
def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target) if _is_path(target) else spark.table(target)


# --- A4 / A5 / A10 ------------------------------------------------------------------------
def write_observed(df: DataFrame, target: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                   metrics: dict[str, Column] | None = None) -> dict:
    """Write a table; ``rows`` and the given aggregates of it come from the write itself."""
    obs = Observation(f"write_{uuid.uuid4().hex}")
    watched = df.observe(obs, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (metrics or {}).items()])
    w = watched.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if _is_path(target):
        w.parquet(target)
    else:
        w.saveAsTable(target)
    return obs.get


def _write(df: DataFrame, target: str, mode: str, partition_by: list[str] | None = None) -> int:
    return int(write_observed(df, target, mode, partition_by).get("rows", 0))


def replace_table(df: DataFrame, target: str, partition_by: list[str] | None = None) -> int:
    """A4 / A10: replace the whole table; returns rows written."""
    return _write(df, target, "overwrite", partition_by)


def append_table(df: DataFrame, target: str, partition_by: list[str] | None = None) -> int:
    """A5: append; returns rows written."""
    return _write(df, target, "append", partition_by)


def load_table(df: DataFrame, target: str, delete_first: bool) -> int:
    """A5 dispatcher: replace when ``delete_first`` else append."""
    return replace_table(df, target) if delete_first else append_table(df, target)


# --- A6 -----------------------------------------------------------------------------------
#: Table -> tables it refers to.
REFERS_TO = {
    "dim_geography": (), "dim_date": (), "dim_product": (), "dim_customer": ("dim_geography",),
    "dim_seller": ("dim_geography",), "fact_sales": ("dim_customer", "dim_seller", "dim_product", "dim_date"),
}


def reset_order() -> list[str]:
    """Children before parents."""
    return list(TopologicalSorter(REFERS_TO).static_order())[::-1]


def reset_warehouse(spark: SparkSession, base: str, tables: list[str] | None = None) -> dict[str, int]:
    """Empty every table (schema kept), children first; a table never written is left out."""
    out = {}
    for t in tables or reset_order():
        path = f"{base.rstrip('/')}/{t}"
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        empty = spark.createDataFrame([], df.schema)
        empty.write.mode("overwrite").parquet(path)
        out[t] = 0
    return out


def truncate_table(spark: SparkSession, path: str) -> None:
    df = spark.read.parquet(path)
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


# --- A7 / A8 --------------------------------------------------------------------------------
def paged_report(df: DataFrame, table: str, page: int = 1, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """A rows page of an allow-listed report table plus its total row count.

    The page is ordered by the table key (the reference reads pages without
    an ORDER BY, so pages were not stable); ``limit(page * size)`` makes it a
    per-task top-k, bounded by the page depth.
    """
    if table not in REPORT_TABLES:
        raise ValueError(f"table {table!r} is not an allowed report")
    page, page_size = int(page), int(page_size)
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page {page} of {page_size} rows: pages start at 1 and have 1 to {MAX_PAGE_SIZE} rows")
    keys = REPORT_TABLES[table]
    rows = df.orderBy(*keys).limit(page * page_size).offset((page - 1) * page_size)
    total = df.agg(F.count(F.lit(1)).cast("long").alias("total_rows"))
    return rows, total


def export_csv(df: DataFrame, table: str, out_dir: str, row_limit: int | None = None) -> int:
    """All rows, or the first ``row_limit``, in key order as CSV part files with a header each."""
    rows = df.orderBy(*(REPORT_TABLES.get(table) or df.columns[:1]))
    return _write_csv(rows if row_limit is None else rows.limit(row_limit), out_dir)


def _write_csv(df: DataFrame, out_dir: str) -> int:
    obs = Observation(f"csv_{abs(hash((out_dir, time.time())))}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(out_dir)
    return int(obs.get.get("rows", 0))


# --- A9 --------------------------------------------------------------------------------------
@dataclass
class StageMetrics:
    """Rows extracted / loaded, seconds, warnings and status per load stage."""
    rows: list = field(default_factory=list)

    def record(self, stage: str, extracted: int, loaded: int, seconds: float, warnings: int = 0,
               status: str = "SUCCESS"):
        self.rows.append((stage, int(extracted), int(loaded), float(round(seconds, 3)), int(warnings), status))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, rows_extracted long, rows_loaded long, "
                                                "seconds double, warnings long, status string")

    def to_csv(self, spark: SparkSession, out_dir: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(out_dir)
