"""Stored summary tables, and the choice of the smallest that answers a question.

Every table has some of the fact's dimensions as columns and the same
measures: revenue, quantity, freight (sums), orders, and customers where
it names them.  Sums add up over anything.  Orders do so over what an
order has one value of (month, state, segment), so a table that splits
orders by category or seller counts them only for one category or seller.
Customers can be counted only where each is named.

The tables stand from coarse to fine; a question names the dimensions it
filters and groups by and the measures it needs, and the first table that
has all of them answers it.  The fact answers everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import COLUMNS, Slice
from ..functions.order_rows import order_rows

UNKNOWN = "unknown"
CUSTOMER = "customer_unique_id"
ORDER_DIMS = ["segment", "state", "month"]


def _sums(revenue: str, freight: str) -> list:
    return [F.sum(revenue).alias("revenue"), F.sum("quantity").cast("long").alias("quantity"), F.sum(freight).alias("freight")]


def _columns(dims) -> list[str]:
    return [COLUMNS[d] for d in dims]


# --- builds ------------------------------------------------------------------------
def order_categories(fact: DataFrame, single: bool = False) -> DataFrame:
    """A row per order and category; ``single`` as in ``order_rows``."""
    sums = {"revenue": F.sum("total_sales_amount"), "quantity": F.sum("quantity").cast("long"), "freight": F.sum("freight_value")}
    return (order_rows(fact, ["order_id", COLUMNS["category"]], [CUSTOMER, *_columns(ORDER_DIMS)], sums, single)
            .withColumn("orders", F.lit(1).cast("long")))


def monthly(orders: DataFrame) -> DataFrame:
    """E13 without customers: segment x state x month, from the orders."""
    return orders.groupBy(*_columns(ORDER_DIMS)).agg(*_sums("revenue", "freight"), F.count(F.lit(1)).alias("orders"))


def categories(by_order: DataFrame) -> DataFrame:
    """Segment x state x category, category known, from the orders by category."""
    known = by_order.where(F.col(COLUMNS["category"]) != UNKNOWN)
    return known.groupBy(*_columns(["segment", "state", "category"])).agg(*_sums("revenue", "freight"), F.count(F.lit(1)).alias("orders"))


def sellers(fact: DataFrame) -> DataFrame:
    """Segment x state x month x seller, seller known."""
    known = fact.where(F.col(COLUMNS["seller"]) != UNKNOWN)
    per_order = (known.groupBy("order_id", COLUMNS["seller"], *_columns(ORDER_DIMS))
                 .agg(F.max("seller_city").alias("seller_city"), F.max("seller_state").alias("seller_state"),
                      *_sums("total_sales_amount", "freight_value")))
    return (per_order.groupBy(*_columns([*ORDER_DIMS, "seller"]))
            .agg(F.max("seller_city").alias("seller_city"), F.max("seller_state").alias("seller_state"),
                 *_sums("revenue", "freight"), F.count(F.lit(1)).alias("orders")))


def customers(orders: DataFrame) -> DataFrame:
    """A row per customer."""
    return (orders.groupBy(CUSTOMER).agg(F.max("segment").alias("segment"), *_sums("revenue", "freight"),
                                         F.count(F.lit(1)).alias("orders")))


def _fact_rows(fact: DataFrame) -> DataFrame:
    return fact.withColumnsRenamed({"total_sales_amount": "revenue", "freight_value": "freight"})


# --- lattice ------------------------------------------------------------------------
@dataclass(frozen=True)
class Cube:
    name: str
    dims: frozenset[str]
    build: Callable            # of the context
    splits: str | None = None  # a dimension that an order may have several values of
    known: str | None = None   # a dimension whose unknown values are left out
    names_customers: bool = False
    counts_orders: bool = True

    def answers(self, s: Slice, by: set[str], need: set[str], known: set[str]) -> bool:
        fixed = set(s.active())
        if not (fixed | by) <= self.dims:
            return False
        if self.known and not (self.known in fixed and s.active()[self.known] != UNKNOWN) and self.known not in known:
            return False
        if "customers" in need and not self.names_customers:
            return False
        return not ("orders" in need and self.splits and self.splits not in fixed | by)


#: From coarse to fine.
CUBES = [
    Cube("categories", frozenset({"segment", "state", "category"}), lambda c: categories(c.cube("order_categories")),
         splits="category", known="category"),
    Cube("monthly", frozenset(ORDER_DIMS), lambda c: monthly(c.orders)),
    Cube("sellers", frozenset({*ORDER_DIMS, "seller"}), lambda c: sellers(c.fact), splits="seller", known="seller"),
    Cube("customers", frozenset({"segment", "customer"}), lambda c: customers(c.orders), names_customers=True),
    Cube("orders", frozenset({*ORDER_DIMS, "customer", "order"}), lambda c: c.orders.withColumn("orders", F.lit(1).cast("long")),
         names_customers=True),
    Cube("order_categories", frozenset({*ORDER_DIMS, "customer", "order", "category"}), lambda c: order_categories(c.fact, c.single_orders),
         splits="category", names_customers=True),
]
FACT = "fact"
NAMES = {c.name: c for c in CUBES}


def candidates(s: Slice, by: set[str], need: set[str], known: frozenset[str] = frozenset()) -> list[str]:
    """Tables that answer the question, the smallest first; the fact last."""
    return [c.name for c in CUBES if c.answers(s, by, need, set(known))] + [FACT]


def source(ctx, s: Slice, by: set[str], need: set[str], using: str | None = None,
           known: frozenset[str] = frozenset()) -> DataFrame:
    """Rows of the slice from the smallest table, or from the one named ``using``.

    With the columns of its dimensions, revenue, quantity, freight and
    orders.  ``known``: dimensions whose unknown values the question
    leaves out itself.  Rows of the fact are first added up to one per
    order and group, so that orders are counted there as well.
    """
    able = candidates(s, by, need, known)
    if using is not None and using not in able:
        raise ValueError(f"{using} does not answer this; {', '.join(able)} do")
    name = using or able[0]
    if name != FACT:
        return s.apply(ctx.cube(name))
    group = sorted(set(_columns(by & set(COLUMNS))) | {"order_id", CUSTOMER})
    rest = [c for c in (*_columns(ORDER_DIMS), "seller_city", "seller_state") if c not in group]
    return (_fact_rows(s.apply(ctx.fact)).groupBy(*group)
            .agg(*[F.max(c).alias(c) for c in rest], *_sums("revenue", "freight")).withColumn("orders", F.lit(1).cast("long")))
