"""Edge cases: dirty ids, repeated lines, null time fields, ties, users without
history, empty input."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import (baskets, composition, departments, evaluate, explore, itemsets,
                                  patterns, quality, recommend, rules, views)
from basketlens.config import AnalysisConfig
from basketlens.dataset import SCHEMAS, conform
from tests.conftest import make_ds


def test_dirty_ids(spark):
    ds = make_ds(spark, {1: [1, 2], 2: [1, 2, 3]},
                 products=[(1, "a", "1", "abc"), (2, "b", "1", " 7 "), (3, "c", "zz", None)],
                 departments=[(7, "seven")])
    r = quality.check(ds).first()
    assert (r.total_products, r.invalid_dept_ids, r.invalid_aisle_ids, r.valid_products) == (3, 2, 1, 1)
    ok, msg, _ = quality.gate(ds)
    assert not ok and msg.startswith("2 products")
    # only product 2 has a numeric department that exists
    assert [(x.department, x.products) for x in explore.top_departments(ds).collect()] == [("seven", 1)]
    # dirty ids never raise; they just do not match
    assert departments.associations(ds, 2, min_co=1).count() == 0
    assert patterns.cross_department(ds, min_lift=0.0, min_count=1).count() == 0


def test_repeated_lines(spark):
    lines = [(1, 1, 1, 0), (1, 1, 2, 0), (1, 2, 3, 0), (2, 3, 1, 0), (2, 3, 2, 0)]
    ds = make_ds(spark, orders=[(1, 9, "prior", 1, 10), (2, 9, "prior", 2, 11)], lines=lines,
                 products=[(1, "a", "1", "1"), (2, "b", "1", "1"), (3, "c", "1", "1")])
    mb = {r.order_id: r for r in baskets.market_baskets(ds, view=None).collect()}
    assert mb[1].basket_size == 3 and mb[1].product_ids == [1, 1, 2]
    tx = {r.order_id: r.items for r in baskets.transactions(ds).collect()}
    assert tx == {1: ["1", "2"], 2: ["3"]}  # line count >= 2, items distinct
    freq, assoc, _ = rules.mine(baskets.transactions(ds), AnalysisConfig(min_support=0.4))
    assert {(tuple(sorted(r["items"])), r.freq) for r in freq.collect()} == {
        (("1",), 1), (("2",), 1), (("1", "2"), 1), (("3",), 1)}
    assert {(tuple(r.antecedent), tuple(r.consequent), r.confidence) for r in assoc.collect()} == {
        (("1",), ("2",), 1.0), (("2",), ("1",), 1.0)}
    hist = {r.product_id: r.purchase_count for r in recommend.history(ds, 9).collect()}
    assert hist == {1: 2, 2: 1, 3: 2}
    # co-occurrence counts distinct orders, not lines
    pairs = itemsets.analyze(ds, 2, 1, None).collect()
    assert [(p.product_1, p.product_2, p.co_occurrence) for p in pairs] == [("a", "b", 1)]
    seq = patterns.sequential(ds, min_count=1, digits=None).collect()
    assert {(s.first_product, s.second_product) for s in seq} == {("a", "a"), ("a", "b"), ("c", "c")}


def test_null_time_fields(spark):
    ds = make_ds(spark, {1: [1, 2], 2: [1, 2]},
                 orders=[(1, 1, "prior", None, None), (2, 1, "prior", 6, 19)])
    got = {(r.time_period, r.day_type, r.pattern_count) for r in patterns.temporal(ds, 2, 1).collect()}
    assert got == {("Night (10pm-5am)", "Weekday", 1), ("Evening (6-9pm)", "Weekend", 1)}
    week = explore.orders_by_weekday(ds).collect()
    assert [(r.total_orders, r.day_of_week) for r in week] == [(1, None), (1, "Saturday")]


def test_ties_are_repeatable(spark):
    ds = make_ds(spark, {o: [1, 2, 3, 4] for o in range(1, 4)})
    first = [tuple(r) for r in itemsets.analyze(ds, 2, 1, limit=3).collect()]
    assert [r[:2] for r in first] == [("item1", "item2"), ("item1", "item3"), ("item1", "item4")]
    assert first == [tuple(r) for r in itemsets.analyze(ds, 2, 1, limit=3).collect()]


def test_user_without_history(spark):
    ds = make_ds(spark, orders=[(1, 1, "prior", 1, 10), (2, 2, "train", 1, 10), (3, 1, "train", 1, 9)],
                 lines=[(1, 1, 1, 0), (1, 2, 2, 0)], train=[(2, 1, 1, 0), (3, 2, 1, 1)],
                 products=[(1, "a", "1", "1"), (2, "b", "1", "1")])
    assert recommend.for_user(ds, 2).count() == 0
    assert recommend.history(ds, 2).count() == 0
    m = evaluate.precision_recall(ds).first()
    # user 2 has no prior lines and drops out; user 1: recs {1,2}, truth {2}
    assert m.total_users == 1
    assert m.avg_correct_predictions == 1.0 and m.avg_precision == 0.5 and m.avg_recall == 1.0


EMPTY_CASES = {
    "pairs": lambda ds: itemsets.analyze(ds, 2, 1, None),
    "quads": lambda ds: itemsets.analyze(ds, 4, 1, 10),
    "search": lambda ds: itemsets.search(ds, "x", 3, 1),
    "directed": lambda ds: itemsets.pairs_directed(ds, "x", 0),
    "top": lambda ds: itemsets.top(ds, 2, "support", 5, min_co=1),
    "dept": lambda ds: departments.associations(ds, 2, 1),
    "dept_conf": lambda ds: departments.pairs_with_confidence(ds, 0),
    "temporal": lambda ds: patterns.temporal(ds, 2, 1),
    "sequential": lambda ds: patterns.sequential(ds, 1),
    "reorder": lambda ds: patterns.reorder(ds, 3, 1),
    "cross": lambda ds: patterns.cross_department(ds, 0.0, 1),
    "composition": lambda ds: composition.basket_sizes(ds),
    "labels": lambda ds: views.pair_labels(ds, 0, view=None),
    "assoc": lambda ds: views.associations(ds, 5, 10, min_co=1, view=False),
    "weekday": explore.orders_by_weekday,
    "hours": explore.orders_by_hour,
    "top_departments": explore.top_departments,
    "by_name": lambda ds: baskets.by_name(ds, view=None),
    "market": lambda ds: baskets.market_baskets(ds, view=None),
    "transactions": baskets.transactions,
    "history": lambda ds: recommend.history(ds, 1),
    "recommend": lambda ds: recommend.for_user(ds, 1),
}


@pytest.mark.parametrize("name", sorted(EMPTY_CASES))
def test_empty_input(spark, name):
    ds = make_ds(spark, orders=[], lines=[], products=[], aisles=[], departments=[])
    df = EMPTY_CASES[name](ds)
    assert df.count() == 0
    assert len(df.columns) > 0


def test_empty_quality_and_metrics(spark):
    ds = make_ds(spark, orders=[], lines=[], products=[], aisles=[], departments=[])
    assert quality.check(ds).first().total_products == 0
    assert evaluate.precision_recall(ds).first().total_users == 0


def test_label_for_any_n(spark):
    ds = make_ds(spark, {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5]})
    five = views.associations(ds, 5, 3, min_co=1, view=False).first()
    assert five.association == "item1 + item2 + item3 + item4 + item5"
    two = views.associations(ds, 2, 1, min_co=1, view=True).first()
    assert two.association == "item1 → item2"
    assert spark.table("top_associations_2item").count() == 1


def test_limit_zero_and_true_top(small):
    assert itemsets.analyze(small, 2, 2, limit=0).count() == 0
    every = itemsets.analyze(small, 2, 2, None, digits=None).collect()
    best = [r.support for r in itemsets.top(small, 2, "support", 7, min_co=2, digits=None).collect()]
    assert best == sorted((r.support for r in every), reverse=True)[:7]
    assert AnalysisConfig().max_transactions is None


def test_sequential_ranged_path_matches_window(small):
    """Orders above the row bound are ranked by ranges; same result as the window."""
    from basketlens.operators.patterns import cart_positions
    base = sorted(tuple(r) for r in cart_positions(small).collect())
    for width in (1, 2, 3):
        assert sorted(tuple(r) for r in cart_positions(small, max_row_items=width).collect()) == base
    a = [tuple(r) for r in patterns.sequential(small, 2, None, None).collect()]
    b = [tuple(r) for r in patterns.sequential(small, 2, None, None, max_row_items=2).collect()]
    assert a == b and len(a) > 0


def test_one_position_of_a_hot_order_is_split(spark):
    """An order with 1 M lines on one position, others without a position or equal in all columns: as the window path, in many tasks."""
    from dataclasses import replace

    from basketlens.operators.patterns import cart_positions
    many = spark.range(1_000_000).select(F.lit(7).cast("long").alias("order_id"), (F.col("id") % 700_000).alias("product_id"),
                                         F.lit(5).alias("add_to_cart_order"), F.lit(0).alias("reordered"))
    nulls = spark.range(30_000).select(F.lit(7).cast("long"), F.col("id") + 5_000_000, F.lit(None).cast("int"), F.lit(0))
    equal = spark.range(20_000).select(F.lit(7).cast("long"), F.lit(9_000_000).cast("long"), F.lit(9), F.lit(0))
    small = spark.createDataFrame([(8, 1, 1, 0), (8, 2, 2, 0), (8, 3, None, 0)], SCHEMAS["order_products_prior"])
    lines = small.union(many).union(nulls).union(equal).repartition(6)
    ds = replace(make_ds(spark, {1: [1]}), order_products_prior=conform(lines, SCHEMAS["order_products_prior"]))
    ranged = cart_positions(ds, 50_000)
    tasks = ranged.where("order_id = 7").groupBy(F.floor(F.col("position") / 100_000)).count().count()
    assert tasks == 11
    sums = ["order_id", F.count("*"), F.sum(F.xxhash64("product_id", "position", "next_product").cast("decimal(38,0)")),
            F.max("position"), F.count("next_product")]
    summed = lambda df: sorted(map(tuple, df.groupBy("order_id").agg(*sums[1:]).collect()))
    assert summed(ranged) == summed(cart_positions(ds, 10 ** 9))
    plan = written_ranges(ds)
    assert len(plan) >= 12 and max(plan) <= 3 * sum(plan) / len(plan)


def written_ranges(ds):
    """Lines per range of the hot order."""
    from basketlens.operators import patterns
    hot = ds.order_products_prior.where("order_id = 7").select("order_id", "product_id", "add_to_cart_order")
    seen = {}
    kept = patterns.written

    def spy(df, name):
        out = kept(df, name)
        if name == "ranges":
            seen.update({r["_r"]: r["count"] for r in out.groupBy("_r").count().collect()})
        return out

    patterns.written = spy
    try:
        patterns._ranged_positions(hot, 16)
    finally:
        patterns.written = kept
    return list(seen.values())


def test_basket_stats_part_the_lines_once(spark):
    """Lines and product rows that come twice, products of two departments; no sets per (order, product)."""
    ds = make_ds(spark, orders=[(o, 1, "prior", 0, 0) for o in (1, 2, 3)] + [(4, 1, "train", 0, 0)],
                 lines=[(1, 1, 1, 0), (1, 1, 2, 0), (1, 2, 3, 0), (2, 3, 1, 0), (2, None, 2, 0), (3, 4, 1, 0), (4, 1, 1, 0)],
                 products=[(1, "a", "1", "1"), (1, "a", "1", "1"), (1, "b", "2", "1"), (2, "c", "2", "2"), (3, "d", "x", "1"),
                           (3, "e", "3", "3"), (4, "f", "x", "1"), (None, "g", "1", "1")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats = composition.basket_stats(ds)
        assert {tuple(r) for r in stats.collect()} == {(1, 2, 2, 2), (2, 1, 1, 1)}
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ObjectHashAggregate(") <= 2      # sets are merged once, not per (order, product) too
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_basket_stats_by_bits_and_by_sets(spark, monkeypatch):
    """More than 64 departments; bits and sets count alike, and bits need no object per order."""
    ids = range(1, 151)
    ds = make_ds(spark, {1: list(ids), 2: [1, 65, 129], 3: [5, 5, 70], 4: [150]},
                 products=[(p, f"p{p}", str(p % 7), str(p % 130)) for p in ids] + [(5, "again", "900", " 5 "), (70, "x", "1", "no")])
    want = {(1, 150, 131, 8), (2, 3, 3, 3), (3, 2, 3, 3), (4, 1, 1, 1)}
    for most, objects in ((1024, False), (100, True), (0, True)):
        monkeypatch.setattr(composition, "BITMAP_VALUES", most)
        stats = composition.basket_stats(ds)
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert ("ObjectHashAggregate(" in plan) == objects
        assert {tuple(r) for r in stats.collect()} == want, most


def test_department_supports_count_distinct_lines_once(spark):
    """The baskets of a department: its rows, as the table is distinct; no rows parted by (order, department) again."""
    ds = make_ds(spark, {1: [1, 1, 2, 3], 2: [1, 2], 3: [3]}, products=[(1, "a", "1", "1"), (2, "b", "1", "2"), (3, "c", "2", "2")],
                 departments=[(1, "one"), (2, "two"), (3, None)])
    lines = departments.department_baskets(ds)
    assert {tuple(r) for r in departments._holding(lines).collect()} == {("one", 2), ("two", 3)}
    kept, departments.itemset_counts, seen = departments.itemset_counts, None, {}
    departments.itemset_counts = lambda *a, **k: seen.update(k) or kept(*a, **k)
    try:
        rows = departments.associations(ds, 2, min_co=1).collect()
        assert [(r.dept_1, r.dept_2, r.co_occurrence) for r in rows] == [("one", "two", 2)]
        assert departments.associations(ds, 2, min_co=3).count() == 0 and seen["item_counts"] is not None
    finally:
        departments.itemset_counts = kept
