"""Business parameters.

The reference hard-codes thresholds tuned to its own data (spend in BRL,
dates in 2016-2018).  Here every such number is a field of ``Params`` so
the same operators run on any table; ``Params.for_fixture`` holds the
values chosen for the driver's TPC-H-like tables (see FIXTURES.md).
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    # Fixed values of the reference (business rules).
    # spending tier edges: <50, <100, <200, <500, <1000, else
    tier_edges: tuple = (50.0, 100.0, 200.0, 500.0, 1000.0)
    currency: str = "R$"
    # rule segment: spend >= vip_min -> vip; more than one order -> repeat; else new
    vip_min: float = 500.0
    # a last month with revenue under this is treated as incomplete
    near_empty_month_revenue: float = 1000.0
    # if set, the rule is taken from the data instead: under this share of the earlier months' mean
    near_empty_month_share: float | None = None
    # recency reference date for RFM features
    rfm_reference_date: str = "2018-09-05"
    # temporal split of the forecasting data
    train_end: str = "2018-03-31"
    valid_start: str = "2018-04-01"
    valid_end: str = "2018-06-15"
    test_start: str = "2018-06-16"
    top_n_categories: int = 5
    top_n_states: int = 5
    top_n_customers: int = 20
    top_n_sellers: int = 20
    top_n_sales_categories: int = 8
    top_n_sales_states: int = 6

    @staticmethod
    def for_fixture() -> "Params":
        """Values for the driver tables (money in the millions, 1995-2001)."""
        return Params(
            tier_edges=(500_000.0, 1_000_000.0, 1_500_000.0, 2_000_000.0, 3_000_000.0),
            currency="$",
            vip_min=2_862_650.0,
            near_empty_month_share=0.1,
            rfm_reference_date="2001-08-02",
            train_end="2000-06-30",
            valid_start="2000-07-01",
            valid_end="2000-12-31",
            test_start="2001-01-01",
        )

    def tier_labels(self) -> list[str]:
        """'Under R$50', 'R$50 - R$100', ..., 'R$1000+' built from the edges."""
        def fmt(x: float) -> str:
            return f"{self.currency}{int(x)}" if x == int(x) else f"{self.currency}{x}"
        e = list(self.tier_edges)
        labels = [f"Under {fmt(e[0])}"]
        labels += [f"{fmt(a)} - {fmt(b)}" for a, b in zip(e, e[1:])]
        labels.append(f"{fmt(e[-1])}+")
        return labels

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def sf_of(sf_dir: str) -> float:
    """Scale factor encoded in a fixture directory name (``.../sf0.01``)."""
    m = re.search(r"sf([0-9.]+)", sf_dir)
    return float(m.group(1).rstrip(".")) if m else 1.0


def to_date(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)
