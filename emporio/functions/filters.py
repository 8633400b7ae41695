"""dashboard slice filters as Column predicates.

Five optional equality filters: month, state, category, segment,
seller.  Placeholder values mean "no filter"; state is upper-cased.
The predicate is an ordinary ``where`` so Catalyst pushes it into the
scan of a materialised (and month-partitioned) denormalised fact.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inputs treated as "no filter".
NO_FILTER = {"all", "all_time", "none", "null", "undefined", ""}

# filter name -> column of the denormalised fact
COLUMNS = {
    "month": "month_year",
    "state": "state_code",
    "category": "product_category_name_english",
    "segment": "segment",
    "seller": "seller_id",
}


def clean(value) -> str | None:
    if value is None:
        return None
    s = str(value).strip()
    return None if s.lower() in NO_FILTER else s


@dataclass(frozen=True)
class Slice:
    month: str | None = None
    state: str | None = None
    category: str | None = None
    segment: str | None = None
    seller: str | None = None

    @staticmethod
    def of(**kw) -> "Slice":
        vals = {k: clean(v) for k, v in kw.items() if k in COLUMNS}
        if vals.get("state"):
            vals["state"] = vals["state"].upper()
        return Slice(**vals)

    def active(self) -> dict[str, str]:
        return {k: getattr(self, k) for k in COLUMNS if getattr(self, k) is not None}

    def without(self, *names: str) -> "Slice":
        kw = {k: getattr(self, k) for k in COLUMNS if k not in names}
        return Slice(**kw)

    def predicate(self) -> Column | None:
        preds = [F.col(COLUMNS[k]) == F.lit(v) for k, v in self.active().items()]
        return functools.reduce(lambda a, b: a & b, preds) if preds else None

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        return df if p is None else df.where(p)

    def sql(self) -> str:
        """Same predicate as SQL text (for the oracle); values are quoted literals."""
        parts = [f"{COLUMNS[k]} = '{v.replace(chr(39), chr(39) * 2)}'" for k, v in self.active().items()]
        return " AND ".join(parts) if parts else "TRUE"
