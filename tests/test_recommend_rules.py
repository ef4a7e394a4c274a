"""Recommendations (single vs many users), FP-Growth vs direct counts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.config import AnalysisConfig
from basketlens.operators import baskets, levelwise, recommend, rules
from basketlens.operators.cooccur import itemset_counts
from tests.conftest import make_ds


def test_many_users_match_single(small):
    users = small.orders.select("user_id").distinct().orderBy("user_id").limit(4)
    many = recommend.for_users(small, users, 5)
    for (u,) in [tuple(r) for r in users.collect()]:
        single = [(r.product_id, r.association_strength, r["rank"])
                  for r in recommend.for_user(small, u, 5).collect()]
        multi = [(r.product_id, r.association_strength, r["rank"])
                 for r in many.where(F.col("user_id") == u)
                 .orderBy(F.col("association_strength").desc(), "product_id").collect()]
        assert single == multi


def plain_strengths(user_orders, lines):
    """{user: {candidate: orders that hold it and an item of the user's}}"""
    out, of_order = {}, {}
    for o, p in lines:
        of_order.setdefault(o, set()).add(p)
    for user in {u for u, _ in user_orders}:
        owned = {p for u, o in user_orders if u == user for p in of_order.get(o, ())}
        found = Counter(p for items in of_order.values() if items & owned for p in items - owned)
        if found:
            out[user] = dict(found)
    return out


@pytest.mark.parametrize("limits", [{}, {"OWNED_ROWS": 60, "HELD_BYTES": 1, "SUM_CELLS": 40, "CHUNK_BASKETS": 64}])
def test_all_users_with_a_hot_order_and_a_hot_item(spark, monkeypatch, limits):
    """One order of 900 items, one item in every second order: all strengths equal brute force, in parts or at once."""
    for name, value in limits.items():
        monkeypatch.setattr(levelwise if name == "CHUNK_BASKETS" else recommend, name, value)
    rng = random.Random(3)
    orders = [(o, rng.randrange(1, 60)) for o in range(1, 400)] + [(900, 70), (901, None)]
    lines = {(o, rng.randrange(2, 300)) for o, _ in orders for _ in range(rng.randrange(5))}
    lines |= {(o, 1) for o, _ in orders if o % 2} | {(900, p) for p in range(1, 901)} | {(5000, 7), (5000, 8)}
    ds = make_ds(spark, orders=[(o, u, "prior", 0, 0) for o, u in orders] + [(3, orders[2][1], "prior", 0, 0)],
                 lines=[(o, p, 1, 0) for o, p in lines] + [(o, p, 2, 0) for o, p in sorted(lines)[:50]] + [(1, None, 1, 0)],
                 products=[(p, f"p{p}", "1", "1") for p in range(1, 901)])
    got = {}
    for r in recommend.for_users(ds, ds.orders.select("user_id"), 1000).collect():
        got.setdefault(r.user_id, {})[r.product_id] = (r.association_strength, r["rank"])
    expected = plain_strengths([(u, o) for o, u in orders if u is not None], lines)
    assert {u: {p: s for p, (s, _) in rows.items()} for u, rows in got.items()} == expected
    for rows in got.values():
        assert all(rank == 1 + sum(s > strength for s, _ in rows.values()) for strength, rank in rows.values())
    best = recommend.for_users(ds, ds.orders.select("user_id"), 3).where("user_id = 5").orderBy("rank", "product_id").collect()
    ordered = sorted(expected[5].items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r.product_id, r.association_strength) for r in best] == ordered


def test_no_user_order_rows_are_shuffled(spark):
    """What the many-user plan shuffles are sums per (user, candidate): neither orders nor lines meet the users."""
    baskets_ = {o: {o % 13 + 1, o % 7 + 20, 1} for o in range(1, 200)}
    ds = make_ds(spark, baskets_, orders=[(o, o % 20, "prior", 0, 0) for o in baskets_])
    plan = recommend.for_users(ds, ds.orders.select("user_id"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "order_id" not in plan and "MapInArrow" not in plan


def test_strength_is_distinct_orders(spark):
    # user 1 owns items 1 and 2; order 10 holds 1, 2 and 3 -> counts once for item 3
    ds = make_ds(spark, orders=[(1, 1, "prior", 0, 0), (10, 2, "prior", 0, 0), (11, 3, "prior", 0, 0)],
                 lines=[(1, 1, 1, 0), (1, 2, 2, 0), (10, 1, 1, 0), (10, 2, 2, 0), (10, 3, 3, 0),
                        (11, 2, 1, 0), (11, 3, 2, 0), (11, 4, 3, 0)],
                 products=[(p, f"p{p}", "1", "1") for p in (1, 2, 3, 4)])
    got = [(r.product_id, r.association_strength, r["rank"]) for r in recommend.for_user(ds, 1).collect()]
    assert got == [(3, 2, 1), (4, 1, 2)]


def test_fpgrowth_matches_direct_counts(small):
    cfg = AnalysisConfig(min_support=0.01, min_confidence=0.1)
    tx = baskets.transactions(small)
    n_tx = tx.count()
    freq, assoc, _ = rules.mine(tx, cfg)
    min_count = math.ceil(cfg.min_support * n_tx)
    lines = tx.select("order_id", F.explode("items").alias("item"))
    for n in (2, 3):
        direct = {tuple(r[f"item_{i}"] for i in range(1, n + 1)): r["count"] for r in
                  itemset_counts(lines, n, item="item", min_count=min_count).collect()}
        mined = {tuple(sorted(r["items"])): r["freq"] for r in
                 rules.of_size(freq, n).collect()}
        assert mined == direct
    assert assoc.where(F.col("lift") < cfg.min_lift).count() == 0
    named = rules.with_names(assoc, small).first()
    assert named is None or len(named.antecedent_names) == len(named.antecedent_ids)


def plain_predictions(rules_, held):
    if held is None or None in held:
        return []
    return sorted({then for given, then in rules_ if set(given) <= set(held) and then not in held})


@pytest.mark.parametrize("limits", [{}, {"SHIPPED_RULES": 40}, {"RULE_WORDS": 3}])
def test_predictions_equal_brute_force_without_a_shuffle(spark, monkeypatch, limits):
    """Rows with repeats, nulls and unknown items, rows that come twice; rules in parts or at once."""
    for name, value in limits.items():
        monkeypatch.setattr(rules, name, value)
    rng = random.Random(5)
    held = [[f"i{rng.randrange(12)}" for _ in range(rng.randrange(6))] for _ in range(300)]
    held += [None, [], ["new"], ["i1", None, "i2"], ["i1", "i1", "i2", "new"], held[0]]
    tx = spark.createDataFrame([(sorted(set(h)),) for h in held[:300] if h], "items array<string>")
    _, _, mined = rules.mine(tx, AnalysisConfig(min_support=0.01, min_confidence=0.05, max_transactions=None))
    every = [(r.antecedent, r.consequent[0]) for r in mined.associationRules.collect()]
    assert len(every) > 100 and len({len(given) for given, _ in every}) > 1
    rows = spark.createDataFrame(list(enumerate(held)), "n long, items array<string>").repartition(3)
    out = mined.transform(rows)
    assert {r.n: r.prediction for r in out.collect()} == {n: plain_predictions(every, h) for n, h in enumerate(held)}
    if not limits:
        plan = mined.transform(spark.range(9).select(F.array(F.lit("i1")).alias("items")))._jdf.queryExecution().executedPlan()
        assert "Exchange" not in plan.toString() and "Join" not in plan.toString()


def test_equal_orders_and_users_count_once_each_and_nothing_passes_the_driver(spark, monkeypatch):
    """37 equal orders of 41 users: three weighted rows and one class; no table of users or orders is collected."""
    def orders_of(u):
        return [(3 * u, {1, 2}), (3 * u + 1, {2, 3, 4})] if u < 37 else [(3 * u, {2, 4, 5}), (3 * u + 1, {u})]

    carts = [(o, u, items) for u in range(41) for o, items in orders_of(u)]
    lines = {(o, p) for o, _, items in carts for p in items}
    ds = make_ds(spark, orders=[(o, u, "prior", 0, 0) for o, u, _ in carts], lines=[(o, p, 1, 0) for o, p in lines],
                 products=[(p, f"p{p}", "1", "1") for p in {p for _, p in lines}])
    chunks = recommend._weighted_orders(ds, ds.order_products_prior.select("order_id", "product_id"),
                                        recommend.basket_profile(ds.order_products_prior))
    rows = sum(r["words"] > 0 and (1 << r["power"]) * bin(int.from_bytes(b"".join(
        bytes(x) for x in [r["bitmaps"]]), "little")).count("1") for r in chunks.collect())
    assert rows == len(lines) and {r["power"] for r in chunks.collect()} == {0, 2, 5}
    monkeypatch.setattr(type(ds.orders), "toArrow", None)
    got = {}
    for r in recommend.for_users(ds, ds.orders.select("user_id"), 100).collect():
        got.setdefault(r.user_id, {})[r.product_id] = r.association_strength
    assert got == plain_strengths([(u, o) for o, u, _ in carts], lines)


def test_orders_lie_sorted_in_chunks(spark):
    """Orders of the first item are one run of bits in a chunk: owners of it have no word of these to count."""
    rng = random.Random(7)
    carts = {o: ({1} if o % 2 else set()) | {rng.randrange(2, 60) for _ in range(5)} for o in range(1, 2000)}
    ds = make_ds(spark, carts)
    chunks = recommend._weighted_orders(ds, ds.order_products_prior.select("order_id", "product_id"),
                                        recommend.basket_profile(ds.order_products_prior)).collect()
    assert max(r["words"] for r in chunks) > 20
    for orders in (recommend._Orders(r["items"], r["words"], r["bitmaps"], r["power"]) for r in chunks):
        mixed = (orders.bitmaps[0] != 0) & (orders.bitmaps[0] != orders.every)
        assert mixed.sum() <= 1


@pytest.mark.parametrize("items, per_order", [(30, 4), (3000, 6)])
def test_sums_of_a_chunk_equal_brute_force(items, per_order):
    """Bitmaps and lists of lines; classes that touch no order, few, most or all of them."""
    rng = random.Random(items)
    carts = sorted({tuple(sorted({3} | {rng.randrange(items) for _ in range(per_order)})) for _ in range(300)})
    carts = [c for c in carts if c != (3,)]
    for shared in (True, False):
        held = [c if shared else tuple(p for p in c if p != 3) for c in carts]
        chunk = levelwise._chunk([(np.repeat(np.arange(len(held)), [len(c) for c in held]),
                                   np.array([p for c in held for p in c], np.int64))], 2)
        row = chunk.to_pylist()[0]
        orders = recommend._Orders(row["items"], row["words"], row["bitmaps"], row["power"])
        assert orders.by_line == (items == 3000)
        owned = [[items + 5], [3], sorted(rng.sample(range(items), items // 2)), sorted(rng.sample(range(items), 3)),
                 list(range(items)), [held[0][0], items + 5]]
        (out,) = recommend._sums([orders], np.arange(len(owned)), np.array([len(o) for o in owned]),
                                 np.array([p for o in owned for p in o]))
        got = {}
        for k, p, c in zip(*(column.to_pylist() for column in out.columns)):
            got.setdefault(k, {})[p] = c
        for k, mine in enumerate(owned):
            expected = Counter(p for c in held if set(c) & set(mine) for p in c if p not in mine)
            assert got.get(k, {}) == {p: 4 * c for p, c in expected.items()}
