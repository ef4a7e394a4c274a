"""Bucket counts stop rare pairs before the shuffle and change no result."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from basketlens.operators import itemsets, pair_filter, patterns
from basketlens.operators.cooccur import itemset_counts
from tests.conftest import make_ds


def sparse_baskets(seed=1, count=400):
    rng = random.Random(seed)
    return {b: {rng.randrange(20, 4000) for _ in range(12)} | {rng.randrange(1, 20) for _ in range(4)} for b in range(count)}


def shuffled(df):
    """Rows that the exchanges of an executed plan wrote."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_fewer_pairs_are_shuffled(spark, monkeypatch):
    baskets = sparse_baskets()
    lines = spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items], "order_id long, product_id long")
    expected = {k: v for k, v in Counter(c for items in baskets.values() for c in combinations(sorted(items), 2)).items() if v >= 6}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = {}
        for name, start in (("plain", 10 ** 12), ("filtered", 1)):
            monkeypatch.setattr(pair_filter, "FILTER_FROM", start)
            df = itemset_counts(lines, 2, min_count=6, prune=False)
            assert {(r.item_1, r.item_2): r["count"] for r in df.collect()} == expected
            seen[name] = shuffled(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(expected) > 100 and seen["filtered"] < seen["plain"] / 4


@pytest.mark.parametrize("bits", [1, 5, 16])
def test_full_buckets_drop_nothing_that_is_frequent(spark, monkeypatch, bits):
    """Few buckets, many pairs in each: more rows pass, the result is the same; pages of any number."""
    monkeypatch.setattr(pair_filter, "PAGE_BUCKETS", 8 if bits > 3 else 2)
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12) for _ in range((a * b) % 7)]
    frame = spark.createDataFrame(pairs, "item_1 long, item_2 long").repartition(3)
    monkeypatch.setattr(pair_filter, "bucket_bits", lambda *a: bits)
    kept = pair_filter.possibly_frequent(frame, ["item_1", "item_2"], len(pairs), 4)
    counts = {(r.item_1, r.item_2): r["count"] for r in kept.groupBy("item_1", "item_2").count().collect()}
    exact = Counter(pairs)
    assert all(counts[p] == exact[p] for p in counts) and {p for p, c in exact.items() if c >= 4} <= counts.keys()
    if bits == 16:
        assert len(counts) < len(exact)


def test_same_rows_for_all_pair_analyses(spark, monkeypatch):
    baskets = sparse_baskets(4, 200)
    ds = make_ds(spark, baskets, orders=[(b, 1, "prior", b % 7, b % 24) for b in baskets])
    runs = {"pairs": lambda: itemsets.pairs(ds, 4, None, digits=None),
            "search": lambda: itemsets.search(ds, "item1", 2, 3, None, None),
            "temporal": lambda: patterns.temporal(ds, 2, 2)}
    for name, run in runs.items():
        monkeypatch.setattr(pair_filter, "FILTER_FROM", 10 ** 12)
        plain = sorted(map(str, run().collect()))
        monkeypatch.setattr(pair_filter, "FILTER_FROM", 1)
        assert sorted(map(str, run().collect())) == plain and plain, name


def test_when_it_pays():
    assert not pair_filter.worth_it(10 ** 6, 50)               # few pairs
    assert pair_filter.worth_it(3 * 10 ** 8, 50)
    assert not pair_filter.worth_it(3 * 10 ** 8, 2)            # buckets would be full of rare pairs
    assert pair_filter.bucket_bits(10, 5) == 16 and pair_filter.bucket_bits(10 ** 12, 5) == 24


def test_no_first_pass_for_few_items(spark, monkeypatch):
    """However many pairs there are: few items make few different ones, counted per key group."""
    monkeypatch.setattr(pair_filter, "FILTER_FROM", 1)
    passes = []
    real = pair_filter.possibly_frequent
    monkeypatch.setattr(pair_filter, "possibly_frequent", lambda *a: passes.append(1) or real(*a))
    baskets = sparse_baskets(4, 200)
    runs = {"pairs": lambda ds: itemsets.pairs(ds, 4, None, digits=None),
            "directed": lambda ds: itemsets.pairs_directed(ds, "item1", 3, None),
            "cross": lambda ds: patterns.cross_department(ds, 0.1, 2),
            "temporal": lambda ds: patterns.temporal(ds, 2, 2, None, "Morning (6-11am)")}
    for name, run in runs.items():
        found = []
        for most in (1 << 20, 0):
            monkeypatch.setattr(pair_filter, "COUNTED_PAIRS", most)
            ds = make_ds(spark, baskets, orders=[(b, 1, "prior", b % 7, b % 24) for b in baskets],
                         products=[(p, f"item{p}", "1", str(p % 2)) for p in range(4000)],
                         departments=[(0, "zero"), (1, "one")])
            passes.clear()
            found.append(sorted(map(str, run(ds).collect())))
            assert bool(passes) == (most == 0), name
        assert found[0] == found[1], name
    items = spark.createDataFrame([(1, i) for i in range(5)] + [(2, i) for i in range(3)], "slot int, product_id long")
    assert pair_filter.different_pairs(items, ["slot"]) == 13 and pair_filter.different_pairs(items.limit(0), []) == 0


def test_a_slot_is_sized_by_its_own_pairs(spark, monkeypatch):
    """Many pairs outside a time slot bring no first pass, and no Python, into the analysis of the slot."""
    monkeypatch.setattr(pair_filter, "FILTER_FROM", 50)
    monkeypatch.setattr(pair_filter, "COUNTED_PAIRS", 0)
    passes = []
    real = pair_filter.possibly_frequent
    monkeypatch.setattr(pair_filter, "possibly_frequent", lambda *a: passes.append(1) or real(*a))
    baskets = {o: list(range(1, 9)) if o > 2 else [1, 2, 3] for o in range(1, 9)}
    ds = make_ds(spark, baskets, orders=[(o, 1, "prior", 6 if o <= 2 else 3, 19) for o in baskets])
    rows = patterns.temporal(ds, 2, 2, None, "Evening (6-9pm)", "Weekend").collect()
    assert [(r.product_1, r.product_2, r.pattern_count) for r in rows] == [
        ("item1", "item2", 2), ("item1", "item3", 2), ("item2", "item3", 2)] and not passes
    assert patterns.temporal(ds, 2, 2, None).count() == 3 + 28 and passes     # all slots: as many as there are
