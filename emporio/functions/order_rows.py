"""Item rows added up by order without sorting them.

The greatest of strings beside sums makes Spark sort every item row; what
items take from their order is grouped by instead.  An order with several
values of it is brought to one row by a second grouping, at order grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_rows(rows: DataFrame, keys: list[str], same: list[str], sums: dict[str, Column], single: bool = False) -> DataFrame:
    """A row per ``keys``: the greatest of each column of ``same``, and ``sums`` (sums or counts).

    ``single``: the rows of an order are known to agree on ``same``, so
    that the first grouping is the result.
    """
    same = [c for c in same if c not in keys]
    first = rows.groupBy(*keys, *same).agg(*[x.alias(n) for n, x in sums.items()])
    if single:
        return first
    again = [F.sum(n).cast(first.schema[n].dataType).alias(n) for n in sums]
    return first.groupBy(*keys).agg(*[F.max(c).alias(c) for c in same], *again)
