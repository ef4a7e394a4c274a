"""Offline quality of "buy again" recommendations against held-out orders.

Truth: the set of products in each user's train order lines.  Prediction: the
user's ``k`` most bought prior products (ties by product id).  Over users with
both: user count, mean hits, mean precision (hits / predicted), mean recall
(hits / truth).
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.functions import metrics as M
from basketlens.operators.cooccur import basket_profile, join_baskets


def _per_user(ds: Dataset, lines: DataFrame) -> DataFrame:
    """(user_id, product_id) of every line, hot orders salted by the profile of the line table."""
    return (join_baskets(lines, ds.orders.select("order_id", "user_id"), profile=basket_profile(lines))
            .select("user_id", "product_id"))


def top_k_per_user(ds: Dataset, k: int = 10) -> DataFrame:
    """(user_id, product_id): each user's ``k`` most bought prior products, ranked
    over the user's (user, product) counts, at most one row per catalog item."""
    freq = (_per_user(ds, ds.order_products_prior).groupBy("user_id", "product_id")
            .agg(F.count(F.lit(1)).alias("purchase_frequency")))
    w = Window.partitionBy("user_id").orderBy(F.col("purchase_frequency").desc(), "product_id")
    return (freq.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= k).select("user_id", "product_id"))


def precision_recall(ds: Dataset, k: int = 10, digits: Optional[int] = None) -> DataFrame:
    """O23 from rows, no arrays: predicted and bought (user, product) rows are
    stacked, merged per (user, product), and counted per user."""
    flags = lambda df, predicted, bought: df.select(
        "user_id", "product_id", F.lit(predicted).alias("p"), F.lit(bought).alias("t"))
    merged = (flags(top_k_per_user(ds, k), 1, 0)
              .unionByName(flags(_per_user(ds, ds.order_products_train), 0, 1))
              .groupBy("user_id", "product_id").agg(F.max("p").alias("p"), F.max("t").alias("t")))
    # a null product is no member of either set, but a user it belongs to has lines
    counted = F.col("product_id").isNotNull().cast("int")
    users = (merged.groupBy("user_id")
             .agg(F.max("p").alias("has_p"), F.max("t").alias("has_t"), F.sum(F.col("p")).alias("predicted"),
                  F.sum(F.col("t") * counted).alias("bought"), F.sum(F.col("p") * F.col("t") * counted).alias("hits"))
             .where((F.col("has_p") == 1) & (F.col("has_t") == 1) & F.col("user_id").isNotNull()))
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        M.rounded(F.avg("hits"), digits).alias("avg_correct_predictions"),
        M.rounded(F.avg(M.as_double("hits") / M.as_double("predicted")), digits).alias("avg_precision"),
        M.rounded(F.avg(M.as_double("hits") / F.nullif(M.as_double("bought"), F.lit(0.0))), digits).alias("avg_recall"),
    )
