"""Cross-operator properties on the sf0.001 fixture."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import composition, itemsets, patterns


def test_temporal_counts_sum_to_pair_counts(small):
    temporal = patterns.temporal(small, 2, min_count=1, limit=None)
    summed = {(r.product_1, r.product_2): r.total for r in
              temporal.groupBy("product_1", "product_2").agg(F.sum("pattern_count").alias("total"))
              .collect()}
    pairs = {(r.product_1, r.product_2): r.co_occurrence for r in
             itemsets.analyze(small, 2, 1, None).collect()}
    assert summed == pairs


def test_composition_shares_sum_to_100(small):
    rows = composition.basket_sizes(small, digits={}).collect()
    assert sum(r.pct_of_total for r in rows) == pytest.approx(100.0, abs=1e-9)
    assert sum(r.basket_count for r in rows) > 0


def test_directed_pairs_agree_with_itemsets(small):
    o15 = {(r.product_1, r.product_2): (r.co_occurrence, r.lift) for r in
           itemsets.analyze(small, 2, 3, None, digits=None).collect()}
    o16 = {(r.product_1, r.product_2): (r.co_occurrence_count, r.lift) for r in
           itemsets.pairs_directed(small, "", 2, limit=100000, digits=None).collect()}
    assert o15 == o16


def test_support_bounds_and_lift_symmetry(small):
    rows = itemsets.analyze(small, 2, 1, None, digits=None).collect()
    assert all(0 < r.support <= 1 for r in rows)
    d = {(r.product_1, r.product_2): r for r in rows}
    # lift of a pair is symmetric: confidence(1->2) / support(2) == confidence(2->1) / support(1)
    o16 = {(r.product_1, r.product_2): r for r in
           itemsets.pairs_directed(small, "", 0, limit=100000, digits=None).collect()}
    total = rows[0].co_occurrence / rows[0].support
    for k, r in o16.items():
        left = r.confidence_1_to_2 / (r.product2_count / total)
        right = r.confidence_2_to_1 / (r.product1_count / total)
        assert left == pytest.approx(right) == pytest.approx(d[k].lift)
