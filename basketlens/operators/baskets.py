"""Baskets and transactions: O7 baskets by name, O8 market baskets,
O9 FP-Growth transactions, O10 scoped caching."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator, Optional

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.operators.cooccur import basket_profile, join_baskets


def by_name(ds: Dataset, view: Optional[str] = "baskets") -> DataFrame:
    """Per order (all prior lines), the set of product names.  Products
    sharing a name merge into one entry."""
    out = (ds.order_products_prior.select("order_id", "product_id")
           .join(ds.products.select("product_id", "product_name"), "product_id")
           .groupBy("order_id")
           .agg(F.array_sort(F.collect_set("product_name")).alias("items")))
    if view:
        out.createOrReplaceTempView(view)
    return out


def market_baskets(ds: Dataset, min_size: int = 2, view: Optional[str] = "market_baskets") -> DataFrame:
    """Per prior order and user, the product names and ids in cart order
    (aligned) and the number of lines; orders with fewer than ``min_size``
    lines are dropped."""
    lines = (join_baskets(ds.order_products_prior, ds.prior_orders.select("order_id", "user_id"),
                          profile=basket_profile(ds.order_products_prior))
             .join(ds.products.select("product_id", "product_name"), "product_id"))
    out = (lines.groupBy("order_id", "user_id")
           .agg(F.array_sort(F.collect_list(F.struct("add_to_cart_order", "product_id",
                                                     "product_name"))).alias("_cart"),
                F.count(F.lit(1)).alias("basket_size"))
           .where(F.col("basket_size") >= min_size)
           .select("order_id", "user_id",
                   F.transform("_cart", lambda x: x["product_name"]).alias("products"),
                   F.transform("_cart", lambda x: x["product_id"]).alias("product_ids"),
                   "basket_size"))
    if view:
        out.createOrReplaceTempView(view)
    return out


def transactions(ds: Dataset, max_n: Optional[int] = None) -> DataFrame:
    """Prior orders with >= 2 lines, distinct item ids as strings (sorted).

    ``max_n`` keeps the ``max_n`` lowest order ids (repeatable); None keeps
    every transaction.
    """
    out = (ds.prior_lines_of_prior_orders().select("order_id", "product_id")
           .groupBy("order_id")
           .agg(F.array_sort(F.collect_set(F.col("product_id").cast("string"))).alias("items"),
                F.count(F.lit(1)).alias("_lines"))
           .where(F.col("_lines") >= 2)
           .select("order_id", "items"))
    if max_n is not None:
        out = out.orderBy("order_id").limit(max_n)
    return out


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Persist for the duration of a block, always released afterwards."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
