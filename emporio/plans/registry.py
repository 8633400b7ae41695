"""Registered queries: name -> (Spark DataFrame builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)``, reads the driver tables of that
directory (through ``Context``) and returns a lazy DataFrame over the
whole tables.  Oracle SQL is rendered for the fixture parameters of the
correctness scale; ``None`` marks queries with no SQL equivalent
(model fits), which get a rows-only check.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Params
from ..functions.filters import Slice
from .context import Context
from .oracle import with_base


@dataclass
class Query:
    name: str
    build: Callable[[Context], DataFrame]
    oracle: Callable[[Params], str] | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: Callable[[Params], str] | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def sql(body: str, extra_ctes: str = ""):
    """Oracle factory for a SQL body over the base CTEs."""
    return lambda p: with_base(body, p, extra_ctes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return q.build(Context.for_fixture(spark, sf_dir))
        run.__name__ = q.name
        return run
    _load_all()
    return {name: bind(q) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    p = Params.for_fixture()
    return {name: q.oracle(p) for name, q in REGISTRY.items() if q.oracle is not None}


def _load_all():
    # importing the modules registers their queries
    from . import (q_dashboard, q_insights, q_quality, q_reporting,  # noqa: F401
                   q_segmentation, q_timeseries, q_warehouse)


# --- helpers shared by the q_* modules ------------------------------------------------
def slice_where(s: Slice) -> str:
    return s.sql()


def orders_sql(s: Slice) -> str:
    """Order-grain rows of a slice in SQL (mirrors dashboard.order_source)."""
    if set(s.active()) <= {"month", "state", "segment"}:
        return f"(SELECT * FROM orders_g WHERE {s.sql()})"
    return f"""(SELECT order_id, max(customer_unique_id) AS customer_unique_id, max(segment) AS segment,
                max(state_code) AS state_code, max(month_year) AS month_year,
                sum(total_sales_amount) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity,
                sum(freight_value) AS freight
         FROM fact WHERE {s.sql()} GROUP BY order_id)"""


# source name -> (oracle CTE, column list); the Spark sources have exactly these columns
def source_sql(name: str) -> str:
    from ..sources.schemas import SOURCES
    cte = {"customers": "src_customers", "orders": "src_orders", "order_items": "src_items",
           "products": "src_products", "sellers": "src_sellers", "payments": "src_payments",
           "reviews": "src_reviews", "geolocation": "src_geo", "categories": "categories"}[name]
    cols = ", ".join(f.name for f in SOURCES[name].fields)
    return f"(SELECT {cols} FROM {cte})"
