"""Filters (F1) and summary-path routing (F2): both physical paths give the same answer."""

import itertools

import pytest

from emporio.functions.filters import Slice
from emporio.operators import cubes
from emporio.operators import dashboard as D
from emporio.plans.context import Context

from conftest import SF_SMALL


def test_filter_cleaning_and_state_upper_case():
    s = Slice.of(month="2018-05", state=" sp ", category="all", segment="undefined", seller="")
    assert s.active() == {"month": "2018-05", "state": "SP"}
    assert Slice.of(month="all_time", state="none").active() == {}


def _rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


QUESTIONS = {
    D.overall_kpis: (set(), {"revenue", "orders", "customers"}),
    D.sales_kpis: (set(), {"revenue", "orders"}),
    D.monthly_trend: ({"month"}, {"revenue", "orders", "customers"}),
    D.category_performance: ({"category"}, {"revenue", "orders", "customers", "quantity"}),
    D.state_performance: ({"state"}, {"revenue", "orders", "customers", "freight"}),
    D.sales_by_state: ({"state"}, {"revenue", "orders"}),
    D.customer_overview: ({"customer"}, {"revenue", "orders", "quantity"}),
    D.customer_snapshot: ({"customer"}, {"revenue", "orders", "quantity"}),
    D.spending_tiers: ({"customer"}, {"revenue", "orders", "quantity"}),
    D.top_customers: ({"customer"}, {"revenue", "orders", "quantity"}),
    D.seller_ranking: ({"seller"}, {"revenue", "orders", "quantity"}),
    D.cube_slice: (set(), {"revenue", "orders", "customers", "quantity"}),
}
VALUES = {"month": "2000-06", "state": "sc", "category": "economy", "segment": "repeat", "seller": "7"}
SUBSETS = [c for n in range(6) for c in itertools.combinations(VALUES, n)]


@pytest.mark.parametrize("fn", QUESTIONS, ids=lambda f: f.__name__)
def test_every_table_gives_the_same_answer(spark, fn):
    """All filter subsets, each on every table that can answer, the fact among them."""
    ctx = Context.for_fixture(spark, SF_SMALL)
    by, need = QUESTIONS[fn]
    known = frozenset({"seller"}) if fn is D.seller_ranking else frozenset()
    read = set()
    for names in SUBSETS:
        s = Slice.of(**{n: VALUES[n] for n in names})
        asked = s.without("month") if fn is D.monthly_trend else s
        tables = cubes.candidates(asked, by, need, known)
        if len(tables) == 1 or len(names) > 2 and len(tables) == 2 and set(tables) <= read:
            continue   # only the fact, or a pair of tables compared before under fewer filters
        answers = [_rows(fn(ctx, s, using=t)) for t in tables]
        assert all(a == answers[0] for a in answers), (names, tables)
        assert _rows(fn(ctx, s)) == answers[0]
        read |= set(tables)
    assert len(read) > 1


def test_the_smallest_table_is_chosen():
    first = lambda by, need, **kw: cubes.candidates(Slice.of(**kw), by, need)[0]
    assert first(set(), {"revenue", "orders"}) == "monthly"
    assert first(set(), {"revenue"}) == "monthly"           # unknown categories count too
    assert first(set(), {"revenue", "orders"}, category="economy") == "categories"
    assert first(set(), {"revenue", "orders"}, category="unknown") == "order_categories"
    assert first(set(), {"revenue", "orders"}, category="economy", month="2000-06") == "order_categories"
    assert first(set(), {"revenue", "orders"}, seller="7", month="2000-06") == "sellers"
    assert first({"customer"}, {"revenue", "orders"}, segment="vip") == "customers"
    assert first({"customer"}, {"revenue", "orders"}, state="sc") == "orders"
    assert first({"category"}, {"orders", "customers"}) == "order_categories"
    assert first(set(), {"orders"}, category="economy", seller="7") == "fact"
    with pytest.raises(ValueError):
        cubes.source(None, Slice(), set(), {"customers"}, "monthly")


def test_trend_is_gap_free(spark):
    ctx = Context.for_fixture(spark, SF_SMALL)
    t = D.monthly_trend(ctx, Slice.of(state="sc")).orderBy("order_month").collect()
    months = [r.order_month for r in t]
    y0, m0 = map(int, months[0].split("-"))
    expected = []
    y, m = y0, m0
    while len(expected) < len(months):
        expected.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    assert months == expected
