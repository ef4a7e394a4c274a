"""The array plan, the chunked plan for oversized baskets and a brute-force
count agree, on the sf0.001 fixture and on random baskets."""

from collections import Counter
from itertools import combinations
from math import comb

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.operators import departments, itemsets, patterns
from basketlens.operators.cooccur import (COMBOS_PER_ROW, basket_profile, chunk_items, itemset_combos, itemset_counts,
                                          join_baskets, pinned, row_limit)


def brute(baskets, n, min_count=1):
    c = Counter()
    for items in baskets.values():
        for combo in combinations(sorted(set(items)), n):
            c[combo] += 1
    return {k: v for k, v in c.items() if v >= min_count}


def as_dict(df, n):
    return {tuple(r[f"item_{i}"] for i in range(1, n + 1)): r["count"] for r in df.collect()}


def test_fixture_all_plans_agree(small):
    lines = small.order_products_prior
    baskets = {}
    for r in lines.select("order_id", "product_id").collect():
        baskets.setdefault(r.order_id, []).append(r.product_id)
    for n, m in ((2, 3), (3, 2), (4, 1)):
        want = brute(baskets, n, m)
        assert as_dict(itemset_counts(lines, n, min_count=m), n) == want
        # every basket with more than 3 lines goes through the chunk path
        assert as_dict(itemset_counts(lines, n, min_count=m, row_items=3, chunk=2), n) == want
        assert as_dict(itemset_counts(lines, n, min_count=m, prune=False), n) == want


def test_keys_and_string_items(spark):
    rows = [(1, "x", "a"), (1, "x", "b"), (2, "x", "a"), (2, "x", "b"), (3, "y", "a"), (3, "y", "b"),
            (3, "y", "a")]
    df = spark.createDataFrame(rows, "order_id long, slot string, dept string")
    got = {(r.slot, r.item_1, r.item_2): r["count"] for r in
           itemset_counts(df, 2, item="dept", keys=["slot"], row_items=1, chunk=1).collect()}
    assert got == {("x", "a", "b"): 2, ("y", "a", "b"): 1}


baskets_strategy = st.dictionaries(
    st.integers(1, 30), st.lists(st.integers(1, 12), min_size=1, max_size=9), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(baskets=baskets_strategy, n=st.integers(2, 4), m=st.integers(1, 3), chunk=st.integers(1, 5))
def test_random_baskets(spark, baskets, n, m, chunk):
    rows = [(o, p) for o, ps in baskets.items() for p in ps]
    df = spark.createDataFrame(rows, "order_id long, product_id long")
    want = brute(baskets, n, m)
    assert as_dict(itemset_counts(df, n, min_count=m, row_items=chunk, chunk=chunk), n) == want


def test_subset_property(small):
    """co(n-set) <= co(any (n-1)-subset)."""
    lines = small.order_products_prior
    pairs = as_dict(itemset_counts(lines, 2), 2)
    triples = as_dict(itemset_counts(lines, 3), 3)
    for t, c in triples.items():
        for sub in combinations(t, 2):
            assert pairs[sub] >= c


def test_null_items_ignored(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, 2)], "order_id long, product_id long")
    assert as_dict(itemset_counts(df, 2), 2) == {(1, 2): 1}
    assert itemset_counts(df.where(F.lit(False)), 2).count() == 0


def test_join_baskets_hot_path_matches_plain_join(small):
    lines = small.order_products_prior
    orders = small.orders.select("order_id", "user_id", "order_dow")
    hot = basket_profile(lines, limit=3)  # every order above 3 lines is "hot"
    assert hot.oversized is not None
    for how in ("inner", "left", "left_semi"):
        plain = lines.join(orders, "order_id", how)
        split = join_baskets(lines, orders, how=how, profile=hot)
        assert sorted(map(tuple, split.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("n,items", [(2, 3000), (3, 260)])
def test_one_huge_basket_is_spread_over_tasks(spark, n, items):
    """The sets of one basket come from many tasks, none with much more than its share."""
    rows = spark.range(items).select(F.lit(1).alias("order_id"), F.col("id").alias("_item"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        chunk = items // 12
        profile = basket_profile(rows, limit=chunk)
        sets = itemset_combos(rows, n, "order_id", "_item", [], profile, chunk)
        per_task = [r["count"] for r in sets.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == comb(items, n)
        assert len(per_task) >= 16 and max(per_task) < comb(items, n) / 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_bounds_follow_n():
    for n in (2, 3, 4, 6):
        assert comb(row_limit(n), n) <= COMBOS_PER_ROW < comb(row_limit(n) + 1, n)
        assert chunk_items(n) ** n <= COMBOS_PER_ROW


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_analyses_without_adaptive_plans(spark, small, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        assert itemsets.analyze(small, 3, 3, None).count() > 0
        assert itemsets.search(small, "red", 2, 3).count() > 0
        assert departments.associations(small, 2, 10).count() > 0
        assert patterns.temporal(small, 2, 3).count() > 0
        assert patterns.cross_department(small, 0.5, 3).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_name_filter_is_below_the_count_and_names_above_the_limit(small):
    plan = itemsets.search(small, "red", 3, 3)._jdf.queryExecution().optimizedPlan().toString()
    cut, count = plan.index("GlobalLimit"), plan.index("Aggregate [item_1")
    assert "product_3#" in plan[:cut] and "product_name" not in plan[cut:count]     # named after the cut
    assert ".tag OR" in plan[count:]                                                # matched before the count


def test_pinned_many_times(spark):
    before = spark.sparkContext.getCheckpointDir()
    for i in range(40):
        table = pinned(spark.range(3))
    assert table.count() == 3 and spark.sparkContext.getCheckpointDir() == before


def test_joined_lines_are_evaluated_once(small):
    """Counts, totals and sets read the table of joined lines, not the line table again."""
    for df in (departments.associations(small, 2, 10), departments.pairs_with_confidence(small, 10),
               patterns.temporal(small, 2, 3)):
        assert "add_to_cart_order" not in df._jdf.queryExecution().optimizedPlan().toString()
