"""Basket size classes and diversity."""

from __future__ import annotations

import math
from functools import reduce
from operator import add
from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.functions import labels as L
from basketlens.functions import metrics as M
from basketlens.operators.cooccur import pinned

BITMAP_VALUES = 1024   # values of a dimension that an order holds as bits: 16 longs

DEFAULT_DIGITS = {"avg_items": 2, "avg_departments": 2, "avg_aisles": 2,
                  "diversity_ratio": 3, "pct_of_total": 2}


def _as_bits(valid: DataFrame, column: str) -> Optional[DataFrame]:
    """``valid`` (product_id, department_id, aisle_id) -> (product_id, one long of 64 bits for every 64 values of
    ``column``: those the product has); None for more than ``BITMAP_VALUES`` values."""
    values = pinned(valid.select(column).distinct())
    count = values.limit(BITMAP_VALUES + 1).count()
    if count > BITMAP_VALUES:
        return None
    numbers = values.withColumn("_n", F.row_number().over(Window.orderBy(column)) - 1)   # BITMAP_VALUES rows at most
    return valid.join(numbers, column).groupBy("product_id").agg(*[
        F.bit_or(F.when(F.floor(F.col("_n") / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_n") % 64))
                 .otherwise(F.lit(0).cast("long"))).alias(f"_{column}_{word}")
        for word in range(max(1, math.ceil(count / 64)))])


def basket_stats(ds: Dataset) -> DataFrame:
    """Per prior order (products with numeric department and aisle ids only):
    distinct items, departments and aisles.

    The lines are parted by ``order_id`` once, for the join with the orders; the
    distinct (order, product) and the counts are formed where they lie then.
    The departments and aisles of a product are one row of a written table: bits,
    that an order's lines are merged from without an object per order, or sets
    where a dimension has more than ``BITMAP_VALUES`` values.
    """
    valid = pinned(ds.products.where(
        F.col("department_id").try_cast("bigint").isNotNull() & F.col("aisle_id").try_cast("bigint").isNotNull()
    ).select("product_id", "department_id", "aisle_id"))
    held, merged, sizes = None, [], {}
    for column in ("department_id", "aisle_id"):
        table = _as_bits(valid, column)
        if table is None:
            table = valid.groupBy("product_id").agg(F.sort_array(F.collect_set(column)).alias(f"_{column}"))
            merged.append(F.size(F.array_distinct(F.flatten(F.collect_set(f"_{column}")))).alias(f"_{column}"))
            sizes[column] = F.col(f"_{column}")
        else:
            words = [c for c in table.columns if c != "product_id"]
            merged += [F.bit_or(word).alias(word) for word in words]
            sizes[column] = reduce(add, [F.bit_count(word) for word in words])
        held = table if held is None else held.join(table, "product_id")
    lines = ds.prior_lines_of_prior_orders().select("order_id", "product_id").distinct().join(pinned(held), "product_id")
    return lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("total_items"), *merged).select(
        "order_id", "total_items", sizes["department_id"].alias("unique_departments"),
        sizes["aisle_id"].alias("unique_aisles"))


def basket_sizes(ds: Dataset, digits: Optional[dict] = None) -> DataFrame:
    digits = DEFAULT_DIGITS if digits is None else digits
    stats = basket_stats(ds).withColumn("basket_size", L.size_class("total_items"))
    per_class = stats.groupBy("basket_size").agg(
        F.count(F.lit(1)).alias("basket_count"),
        F.avg("total_items").alias("avg_items"),
        F.avg("unique_departments").alias("avg_departments"),
        F.avg("unique_aisles").alias("avg_aisles"),
        F.avg(M.as_double("unique_aisles") / M.as_double("total_items")).alias("diversity_ratio"),
    )
    # at most four rows: an unpartitioned window is bounded here
    everything = Window.partitionBy()
    out = per_class.select(
        "basket_size", "basket_count",
        *[M.rounded(F.col(c), digits.get(c)).alias(c)
          for c in ("avg_items", "avg_departments", "avg_aisles", "diversity_ratio")],
        M.rounded(M.percent("basket_count", F.sum("basket_count").over(everything)),
                  digits.get("pct_of_total")).alias("pct_of_total"),
    )
    return out.orderBy(L.size_class_rank("basket_size"))
