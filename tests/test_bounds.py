"""Top-k with bounds equals the full ranking, ties included."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketlens.operators import bounds, itemsets, patterns
from tests.conftest import make_ds


def skewed(seed, baskets=200, items=60):
    rng = random.Random(seed)
    return {b: {min(items, int(rng.paretovariate(0.6))) for _ in range(rng.randrange(1, 9))} for b in range(baskets)}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10 ** 6), n=st.sampled_from([2, 2, 3]), limit=st.integers(1, 12), rounded=st.booleans(),
       metric=st.sampled_from(["lift", "support", "co_occurrence"]))
def test_top_equals_the_full_ranking(spark, seed, n, limit, rounded, metric):
    ds = make_ds(spark, skewed(seed, 120))
    digits = itemsets.DEFAULT_DIGITS if rounded else None
    run = lambda: [tuple(r) for r in itemsets.top(ds, n, metric, limit, min_co=2, digits=digits).collect()]
    before = bounds.SEED_ITEMS
    try:
        bounds.SEED_ITEMS = 10 ** 6
        full = run()
        bounds.SEED_ITEMS = 6
        assert run() == full
    finally:
        bounds.SEED_ITEMS = before


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_cross_department_equals_the_full_ranking(spark, monkeypatch, limit):
    baskets = skewed(3, 400)
    ids = sorted({p for items in baskets.values() for p in items})
    ds = make_ds(spark, baskets, products=[(p, f"item{p}", "1", str(p % 4)) for p in ids],
                 departments=[(d, f"dept{d}") for d in range(4)])
    run = lambda: [tuple(r) for r in patterns.cross_department(ds, 1.1, 2, limit).collect()]
    monkeypatch.setattr(bounds, "SEED_ITEMS", 10 ** 6)
    full = run()
    monkeypatch.setattr(bounds, "SEED_ITEMS", 5)
    assert run() == full and len(full) == limit


def test_frequent_items_are_left_out(spark, monkeypatch):
    """By lift the frequent items go, by support the rare ones; ties at the end stay."""
    monkeypatch.setattr(bounds, "SEED_ITEMS", 4)
    baskets = {b: {1, 100 + b // 4} for b in range(80)} | {200 + b: {1, 2, 300 + b % 2} for b in range(30)}
    ds = make_ds(spark, baskets)
    kept = {}
    real = bounds.promising

    def spy(*args):
        found = real(*args)
        kept[args[2]] = None if found is None else {r.product_id for r in found.collect()}
        return found

    monkeypatch.setattr(bounds, "promising", spy)
    best = itemsets.top(ds, 2, "support", 1, min_co=2, digits=None).collect()
    assert [(r.product_1, r.product_2, r.co_occurrence) for r in best] == [("item1", "item2", 30)]
    assert kept["support"] == {1, 2} and itemsets.top(ds, 2, "confidence", 1, min_co=2).count() == 1
    assert kept["confidence"] is None
    rare = itemsets.top(ds, 2, "lift", 3, min_co=2, digits=None).collect()
    assert len(rare) == 3 and kept["lift"] is None        # the rarest items share no order: nothing to bound by
    monkeypatch.setattr(bounds, "SEED_ITEMS", 3)
    more = make_ds(spark, {b: {1 + b % 2, 3} for b in range(50)} | {100 + b: {10 + b % 6 * 2, 11 + b % 6 * 2} for b in range(24)})
    best = itemsets.top(more, 2, "lift", 1, min_co=2, digits=None).collect()
    assert best[0].lift == 74 / 4 and kept["lift"] == set(range(10, 22))


def test_values_of_the_bounds(spark):
    sets = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "lift double")
    assert [bounds.kth_best(sets, "lift", k) for k in (0, 1, 2, 3, 4)] == [None, 3.0, 2.0, 1.0, None]
    assert bounds.greatest_support(4.0, 100, 2, 7) == 25 and bounds.greatest_support(4.0, 100, 3, 5) == 500
    assert bounds.greatest_support(0.0, 100, 2, 5) == float("inf") and bounds.rounding(3.0, 2) == 0.01
    assert bounds.promising(sets, None, "lift", None, 2, 10, 1, None) is None
