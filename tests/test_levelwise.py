"""Level-wise mining: equal to brute force and to Spark ML, with few candidates on large baskets; rules and predictions."""

import random
from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from basketlens.config import AnalysisConfig
from basketlens.operators import itemsets, levelwise, rules
from basketlens.operators.cooccur import expanded_sets
from tests.conftest import make_ds


def brute(baskets, n, min_count):
    counted = Counter(c for items in baskets.values() for c in combinations(sorted(set(items)), n))
    return {k: v for k, v in counted.items() if v >= min_count}


def frame(spark, baskets):
    return spark.createDataFrame([(b, i) for b, items in baskets.items() for i in items], "order_id long, product_id long")


def as_dict(df, n):
    return {tuple(r[f"item_{i}"] for i in range(1, n + 1)): r["count"] for r in df.collect()}


def mixed_baskets(seed, count=300, usual=8):
    rng = random.Random(seed)
    return {b * 7: {rng.randrange(1, usual) if rng.random() < .5 else rng.randrange(1, 40) for _ in range(rng.randrange(1, 22))}
            for b in range(count)}


@pytest.mark.parametrize("chunk, shipped, least", [(1 << 15, 1 << 20, 30), (64, 40, 30), (64, 1 << 20, 12)])
def test_levels_equal_brute_force(spark, monkeypatch, chunk, shipped, least):
    """One chunk or many, one part of candidates or many: the same sets."""
    monkeypatch.setattr(levelwise, "CHUNK_BASKETS", chunk)
    monkeypatch.setattr(levelwise, "SHIPPED_SETS", shipped)
    baskets = mixed_baskets(3)
    lines = frame(spark, baskets)
    lines = lines.unionByName(lines.where("product_id < 5")).unionByName(      # repeated lines, nulls
        spark.createDataFrame([(0, None), (None, 3)], "order_id long, product_id long"))
    levels = levelwise.frequent_levels(lines, least, baskets=len(baskets))
    for n, level in enumerate(levels, 1):
        assert as_dict(level, n) == brute(baskets, n, least)
    assert not brute(baskets, len(levels) + 1, least) and len(levels) >= 4


def test_counting_in_a_chunk_is_plain_and(spark):
    rng = np.random.default_rng(0)
    items, held = np.arange(10, 30), rng.random((20, 200)) < 0.3
    held[5] = False
    bitmaps = np.packbits(np.pad(held, ((0, 0), (0, 56))), axis=1, bitorder="little").view(np.uint64)
    sets = np.array(sorted(combinations(range(8, 33), 3)))
    rows, counts = levelwise.count_in_chunk(sets, items, bitmaps)
    expected = {}
    for s in sets.tolist():
        if all(10 <= i < 30 for i in s):
            count = int(held[[i - 10 for i in s]].all(axis=0).sum())
            if count:
                expected[tuple(s)] = count
    assert {tuple(sets[r].tolist()): int(c) for r, c in zip(rows, counts)} == expected


def test_candidates_need_all_subsets(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (1, 5), (4, 5)], "item_1 long, item_2 long")
    assert sorted(map(tuple, levelwise.candidates(pairs, 2).collect())) == [(1, 2, 3), (2, 3, 4)]
    triplets = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (2, 3, 5), (2, 4, 5)],
                                     "item_1 long, item_2 long, item_3 long")
    assert sorted(map(tuple, levelwise.candidates(triplets, 3).collect())) == [(1, 2, 3, 4)]


def test_large_baskets_form_few_sets(spark, monkeypatch):
    """Baskets of 120 items: the sets formed are counted, and are far fewer than C(120, 4)."""
    rng = random.Random(8)
    core = list(range(1, 9))
    baskets = {b: set(core if b % 2 else []) | {rng.randrange(100, 6000) for _ in range(120)} for b in range(60)}
    formed = {}
    counted = levelwise.count_candidates

    def spy(chunks, found, n, *args):
        formed[n] = found.count()
        return counted(chunks, found, n, *args)

    monkeypatch.setattr(levelwise, "count_candidates", spy)
    ds = make_ds(spark, baskets)
    sets, lines = expanded_sets(ds.order_products_prior, 4)
    assert sets == sum(comb(len(items), 4) for items in baskets.values()) and sets > itemsets.EXPANDED_PER_LINE * lines
    got = itemsets.quadruplets(ds, min_co=25, limit=None, digits=None).collect()
    assert {r.product_1 for r in got} <= {f"item{i}" for i in core} and len(got) == comb(8, 4)
    assert all(r.co_occurrence == 30 and r.support == 0.5 for r in got)
    assert formed[3] + formed[4] == comb(8, 3) + comb(8, 4) < sets / 1e6


@pytest.mark.parametrize("n, pattern", [(3, None), (4, None), (3, "item2"), (4, "item7")])
def test_both_ways_give_the_same_rows(spark, monkeypatch, n, pattern):
    ds = make_ds(spark, mixed_baskets(5, 150))
    run = lambda: sorted(map(tuple, itemsets.scored_itemsets(ds, n, 8, None, pattern=pattern).collect()))
    monkeypatch.setattr(itemsets, "EXPANDED_PER_LINE", 10 ** 12)
    listed = run()
    monkeypatch.setattr(itemsets, "EXPANDED_PER_LINE", 0)
    assert run() == listed and len(listed) > 10


def test_no_frequent_sets(spark):
    ds = make_ds(spark, {b: {b, b + 1000, b + 2000} for b in range(40)})
    assert itemsets._by_levels(ds, ds.order_products_prior, ds.order_products_prior.select("product_id").distinct(), 3, 2, "c",
                               False).collect() == []
    freq, assoc, _ = rules.mine(spark.createDataFrame([], "items array<string>"))
    assert freq.collect() == [] and assoc.collect() == []


def test_mining_equals_spark_ml(spark):
    """Itemsets, rules and predictions against FPGrowth on transactions of strings."""
    rows = [([f"p{i}" for i in items],) for items in mixed_baskets(11, 200, 12).values()]
    tx = spark.createDataFrame(rows, "items array<string>")
    cfg = AnalysisConfig(min_support=0.07, min_confidence=0.4, min_lift=1.1)
    freq, assoc, mined = rules.mine(tx, cfg)
    model = FPGrowth(itemsCol="items", minSupport=0.07, minConfidence=0.4).fit(tx)
    sets = lambda df: {(tuple(sorted(r["items"])), r["freq"]) for r in df.collect()}
    assert sets(freq) == sets(model.freqItemsets) and freq.count() == model.freqItemsets.count()

    def rule_rows(df):
        return {(tuple(sorted(r.antecedent)), tuple(r.consequent)): (r.confidence, r.lift, r.support) for r in df.collect()}

    ours, theirs = rule_rows(mined.associationRules), rule_rows(model.associationRules)
    assert ours.keys() == theirs.keys() and len(ours) > 50
    assert all(ours[k] == pytest.approx(theirs[k], rel=1e-12) for k in ours)
    assert rule_rows(assoc) == {k: v for k, v in ours.items() if v[1] >= 1.1}

    probes = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows[:40])] + [(90, []), (91, None), (92, ["none"])],
                                   "k int, items array<string>")
    predicted = lambda df: {r.k: sorted(r.prediction) for r in df.collect()}
    assert predicted(mined.transform(probes)) == predicted(model.transform(probes))


def test_mined_results_are_files(spark):
    """Nothing is mined again by those who read the results, and a Dataset is mined once."""
    ds = make_ds(spark, mixed_baskets(2, 60))
    cfg = AnalysisConfig(min_support=0.1)
    freq, assoc, mined = rules.mine_dataset(ds, cfg)
    for df in (freq, assoc, mined.associationRules):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "MapInArrow" not in plan and "Aggregate" not in plan
    assert rules.mine_dataset(ds, cfg)[0] is freq
    assert rules.mine_dataset(ds, AnalysisConfig(min_support=0.2))[0] is not freq
    assert mined.spark_model().freqItemsets.count() == freq.count()
