"""Behavioural patterns: O24 temporal, O25 sequential, O27 reorder loyalty,
O28 cross-department synergies."""

from __future__ import annotations

import math
from typing import List, Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.config import check_itemset_size
from basketlens.dataset import Dataset
from basketlens.functions import labels as L
from basketlens.functions import metrics as M
from basketlens.operators import bounds
from basketlens.operators.cooccur import (HOT_LINES, basket_profile, itemset_counts, join_baskets, member_names,
                                          pinned, pinned_supports, top_rows, with_members)
from basketlens.session import written

RANGES_PER_TASK = 4   # ranges of hot orders per shuffle partition of the session


def _dimensions(ds: Dataset) -> DataFrame:
    """product_id, product_name, department_id and department (null when unknown)."""
    return (ds.products_clean.join(ds.departments, "department_id", "left")
            .select("product_id", "product_name", "department_id", "department"))


def _named_top(ds: Dataset, sets: DataFrame, n: int, first: str, keys: Sequence[str], limit: Optional[int]) -> DataFrame:
    """The first ``limit`` sets by ``first`` (ties by keys, then product ids), with
    the names and departments of their members joined after the cut."""
    order: List[Column] = [F.desc(first), *map(F.col, keys), *map(F.col, member_names(n))]
    kept = top_rows(sets, order, limit)
    named = with_members(kept, n, _dimensions(ds), "product_id",
                         {"product_name": "product_{i}", "department": "dept_{i}"})
    return named.orderBy(*order)


def temporal(ds: Dataset, n: int = 2, min_count: int = 50, limit: Optional[int] = 200,
             time_period: Optional[str] = None, day_type: Optional[str] = None) -> DataFrame:
    """N-sets per (time period, day type) of prior orders, count >= ``min_count``;
    O24b: only one period and / or day type, whose orders alone are read then."""
    n = check_itemset_size(n)
    slots = ds.prior_orders.select(
        "order_id",
        L.time_period("order_hour_of_day").alias("time_period"),
        L.day_type("order_dow").alias("day_type"),
    )
    for name, value in (("time_period", time_period), ("day_type", day_type)):
        if value is not None:
            slots = slots.where(F.col(name) == value)
    prior = ds.order_products_prior
    # the joined lines serve the pruning counts and the sets
    lines = written(join_baskets(prior, slots, profile=basket_profile(prior))
                    .join(ds.products.select("product_id"), "product_id", "left_semi")
                    .select("order_id", "product_id", "time_period", "day_type"), "slots")
    keys = ["time_period", "day_type"]
    # the lines of one slot are few of all: how many pairs they make is read from them
    sets = itemset_counts(lines, n, keys=keys, min_count=min_count, count_col="pattern_count",
                          profile_lines=prior if time_period is None and day_type is None else lines)
    return _named_top(ds, sets, n, "pattern_count", keys, limit).select(
        *keys, *[f"product_{i}" for i in range(1, n + 1)], "pattern_count",
        *[f"dept_{i}" for i in range(1, n + 1)],
        F.concat(F.col("day_type"), F.lit(L.CONTEXT_SEP), F.col("time_period")).alias("shopping_context"))


def cart_positions(ds: Dataset, max_row_items: int = HOT_LINES) -> DataFrame:
    """Prior lines with ``position`` (1-based cart order; ties by product id) and
    the product placed right after (``next_product``).

    Orders up to ``max_row_items`` lines are ranked with a window per order.
    The lines of larger orders are dealt by ranges of (order, position, product)
    whose bounds Spark samples, about ``max_row_items`` lines each (more where
    that would be over ``RANGES_PER_TASK`` ranges a shuffle partition); every range
    is ranked on its own, a per-order table of range sizes (one row per range)
    gives the offsets, and the first item of the next range is the successor of
    a range's last line.  So no order, and no position that many lines of an
    order share or lack, is ranked in one task.
    """
    lines = ds.order_products_prior.select("order_id", "product_id", "add_to_cart_order")
    split = basket_profile(ds.order_products_prior, "order_id", max_row_items).oversized
    normal = lines if split is None else lines.join(split.select("order_id"), "order_id", "left_anti")
    w = Window.partitionBy("order_id").orderBy("add_to_cart_order", "product_id")
    steps = normal.select("order_id", "product_id",
                          F.row_number().over(w).alias("position"),
                          F.lead("product_id").over(w).alias("next_product"))
    if split is not None:
        count = split.agg(F.sum("_k")).first()[0]
        tasks = RANGES_PER_TASK * int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        steps = steps.unionByName(_ranged_positions(lines.join(split.select("order_id"), "order_id"),
                                                    min(tasks, math.ceil(count / max_row_items))))
    return steps


def _ranged_positions(lines: DataFrame, ranges_wanted: int) -> DataFrame:
    # a number by chance parts lines that are equal in all columns; which comes first makes no difference
    keys = ["order_id", "add_to_cart_order", "product_id", "_tie"]
    ranged = written(lines.withColumn("_tie", F.rand(5)).repartitionByRange(ranges_wanted, *keys)
                     .withColumn("_r", F.spark_partition_id()), "ranges")
    w_in = Window.partitionBy("order_id", "_r").orderBy(*keys[1:])
    local = ranged.select("order_id", "_r", "product_id",
                          F.row_number().over(w_in).alias("_lp"),
                          F.lead("product_id").over(w_in).alias("_next"))
    ranges = ranged.groupBy("order_id", "_r").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(*keys[1:])).alias("_first"))
    w_r = Window.partitionBy("order_id").orderBy("_r")
    ranges = ranges.select(
        "order_id", "_r", "_n",
        F.coalesce(F.sum("_n").over(w_r.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.lead(F.col("_first")["product_id"]).over(w_r).alias("_next_first"))
    return local.join(ranges, ["order_id", "_r"]).select(
        "order_id", "product_id",
        (F.col("_offset") + F.col("_lp")).cast("int").alias("position"),
        F.when(F.col("_lp") == F.col("_n"), F.col("_next_first")).otherwise(F.col("_next"))
        .alias("next_product"))


def sequential(ds: Dataset, min_count: int = 80, limit: Optional[int] = 100,
               digits: Optional[int] = 1, max_row_items: int = HOT_LINES) -> DataFrame:
    """Ordered pairs placed next to each other in a cart, count >= ``min_count``."""
    steps = cart_positions(ds, max_row_items).where(F.col("next_product").isNotNull())
    seq = (steps.groupBy(F.col("product_id").alias("_first"), F.col("next_product").alias("_second"))
           .agg(F.count(F.lit(1)).alias("sequence_count"),
                F.avg("position").alias("_avg1"),
                F.avg(F.col("position") + 1).alias("_avg2"))
           .where(F.col("sequence_count") >= min_count))
    dims = ds.product_dims
    known = dims.select("product_id")
    for key in ("_first", "_second"):
        seq = seq.join(known.withColumnRenamed("product_id", key), key, "left_semi")
    order = [F.desc("sequence_count"), F.col("_first"), F.col("_second")]
    seq = top_rows(seq, order, limit)
    for tag, key in (("first", "_first"), ("second", "_second")):
        side = dims.select(F.col("product_id").alias(key),
                           F.col("product_name").alias(f"{tag}_product"),
                           F.col("department").alias(f"{tag}_dept"),
                           F.col("aisle").alias(f"{tag}_aisle"))
        seq = seq.join(side, key)
    return seq.orderBy(*order).select(
        "first_product", "second_product", "sequence_count",
        M.rounded(F.col("_avg1"), digits).alias("avg_first_pos"),
        M.rounded(F.col("_avg2"), digits).alias("avg_second_pos"),
        "first_dept", "second_dept", "first_aisle", "second_aisle",
    )


def reorder(ds: Dataset, n: int = 2, min_count: int = 100, limit: Optional[int] = 100) -> DataFrame:
    """N-sets where every member line was a reorder; known departments only."""
    n = check_itemset_size(n)
    known = _dimensions(ds).where(F.col("department").isNotNull()).select("product_id")
    lines = ds.order_products_prior.where(F.col("reordered") == 1).join(known, "product_id", "left_semi")
    sets = itemset_counts(lines, n, min_count=min_count, count_col="reorder_count",
                          profile_lines=ds.order_products_prior)
    if n == 2:
        loyalty = F.when(F.col("dept_1") == F.col("dept_2"), F.lit(L.SAME_DEPT)) \
            .otherwise(F.lit(L.CROSS_DEPT))
    else:
        loyalty = F.lit(L.MULTI)
    return _named_top(ds, sets, n, "reorder_count", [], limit).select(
        *[f"product_{i}" for i in range(1, n + 1)], "reorder_count",
        *[f"dept_{i}" for i in range(1, n + 1)], loyalty.alias("loyalty_type"))


def cross_department(ds: Dataset, min_lift: float = 2.5, min_count: int = 30,
                     limit: Optional[int] = 100, digits: Optional[dict] = None) -> DataFrame:
    """Pairs of products from different (known) departments with
    count >= ``min_count`` and lift rounded to 2 digits > ``min_lift``.

    The department id travels with the item, so pairs inside one department
    are dropped before they are counted.  Items too frequent for ``min_lift``,
    or for the lift of the last of the ``limit`` rows, are left out (``bounds``)."""
    digits = {"confidence": 4, "lift": 2} if digits is None else digits
    prior = ds.order_products_prior
    total = basket_profile(prior).baskets
    least = bounds.greatest_support(min_lift - bounds.rounding(min_lift, 2), total, 2, min_count)
    supports = pinned_supports(prior)
    items = pinned(supports.where((F.col("support_count") >= min_count) & (F.col("support_count") <= least))
                   .join(ds.products_clean.where(F.col("department_id").isNotNull()), "product_id")
                   .select("product_id", "department_id", "support_count"))

    def scored(some: Optional[DataFrame]) -> DataFrame:
        kept = items if some is None else items.join(some, "product_id", "left_semi")
        sets = itemset_counts(prior.join(kept.drop("support_count"), "product_id"), 2, min_count=min_count, prune=False,
                              count_col="pair_count", profile_lines=prior, tag="department_id",
                              keep=lambda dept: dept[0] != dept[1], known=kept)
        sets = with_members(sets, 2, supports, "product_id", {"support_count": "_s{i}"})
        raw_lift = M.lift("pair_count", F.lit(total), ["_s1", "_s2"])
        return sets.where(F.round(raw_lift, 2) > F.lit(min_lift)).select(
            "item_1", "item_2", "pair_count",
            M.rounded(M.confidence("pair_count", ["_s1"]), digits.get("confidence")).alias("confidence"),
            M.rounded(raw_lift, digits.get("lift")).alias("lift"))

    able = bounds.promising(items.select("product_id", "support_count"), scored, "lift", limit, 2, total, min_count,
                            digits.get("lift"))
    return _named_top(ds, scored(able), 2, "lift", [], limit).select(
        F.col("dept_1").alias("department_1"), F.col("dept_2").alias("department_2"),
        "product_1", "product_2", "pair_count", "confidence", "lift")
