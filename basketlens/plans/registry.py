"""Registered queries: name -> (Spark callable, oracle SQL or None).

Parameters follow the scale of the sf0.01 fixture (64 items), where the
reference's thresholds (co >= 50 on millions of orders) would select nothing
or everything.  Metrics are unrounded on both sides (``digits=None``), float
averages are rounded to 9 digits on both sides.  Every limited query has a
total order so that the rows kept are the same on both sides.
"""

from __future__ import annotations

from typing import Callable, Dict, Optional, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.config import AnalysisConfig
from basketlens.operators import (baskets, composition, departments, evaluate, explore, itemsets,
                                  patterns, quality, recommend, rules, views)
from basketlens.plans import oracle as O
from basketlens.session import scratch_path
from basketlens.sources import ingest
from basketlens.sources.tpch import from_tpch

QueryFn = Callable[[SparkSession, str], DataFrame]
DatasetFn = Callable[[Dataset], DataFrame]
REGISTRY: Dict[str, Tuple[QueryFn, Optional[str]]] = {}
ON_DATASET: Dict[str, Tuple[DatasetFn, bool]] = {}  # name -> (fn, needs dirty ids)

RAW = None  # unrounded metrics


def register(name: str, sql: Optional[str]):
    def wrap(fn: Callable[[Dataset], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(from_tpch(spark, sf_dir))
        REGISTRY[name] = (run, sql)
        ON_DATASET[name] = (fn, False)
        return fn
    return wrap


def register_part(name: str, sql: Optional[str]):
    """Queries on the sparse fixture, one item per part."""
    def wrap(fn: Callable[[Dataset], DataFrame]):
        REGISTRY[name] = (lambda spark, sf_dir: fn(from_tpch(spark, sf_dir, grain="part")), sql)
        return fn
    return wrap


def register_dirty(name: str, sql: Optional[str]):
    def wrap(fn: Callable[[Dataset], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(from_tpch(spark, sf_dir, dirty=True))
        REGISTRY[name] = (run, sql)
        ON_DATASET[name] = (fn, True)
        return fn
    return wrap


# ----------------------------------------------------------------- O15, O33-35
@register("itemset_pairs", O.itemsets(2, 30))
def _pairs(ds):
    return itemsets.analyze(ds, 2, min_co=30, limit=None, digits=RAW)


@register("itemset_triplets", O.itemsets(3, 5))
def _triplets(ds):
    return itemsets.analyze(ds, 3, min_co=5, limit=None, digits=RAW)


@register("itemset_quads", O.itemsets(4, 2))
def _quads(ds):
    return itemsets.analyze(ds, 4, min_co=2, limit=None, digits=RAW)


# ----------------------------------------------------------------- O16-O18
@register("pairs_directed", O.pairs_directed("ring", 30, 20))
def _pairs_directed(ds):
    return itemsets.pairs_directed(ds, "ring", min_co_exclusive=30, limit=20, digits=RAW)


@register("itemset_search", O.itemsets(3, 5, limit=20, pattern="red"))
def _search(ds):
    return itemsets.search(ds, "red", n=3, min_co=5, limit=20, digits=RAW)


@register("top_by_confidence", O.top_by(2, 30, "confidence", 30))
def _top_conf(ds):
    return itemsets.top(ds, 2, "confidence", 30, min_co=30, digits=RAW)


@register("top_by_support", O.top_by(2, 30, "support", 30))
def _top_support(ds):
    return itemsets.top(ds, 2, "support", 30, min_co=30, digits=RAW)


# ----------------------------------------------------------------- O19, O20
@register("dept_pairs", O.dept_sets(2, 1000))
def _dept_pairs(ds):
    return departments.associations(ds, 2, min_co=1000, digits=RAW)


@register("dept_triplets", O.dept_sets(3, 100))
def _dept_triplets(ds):
    return departments.associations(ds, 3, min_co=100, digits=RAW)


@register("dept_pairs_conf", O.dept_pairs_conf(1000))
def _dept_pairs_conf(ds):
    return departments.pairs_with_confidence(
        ds, 1000, digits={"support_pct": RAW, "confidence": RAW})


# ----------------------------------------------------------------- O24, O25, O27, O28
@register("temporal_pairs", O.temporal(2, 10))
def _temporal(ds):
    return patterns.temporal(ds, 2, min_count=10)


@register("sequential", O.sequential(5))
def _sequential(ds):
    return patterns.sequential(ds, min_count=5, digits=RAW)


@register("reorder_pairs", O.reorder(2, 5))
def _reorder(ds):
    return patterns.reorder(ds, 2, min_count=5)


@register("reorder_triplets", O.reorder(3, 2))
def _reorder3(ds):
    return patterns.reorder(ds, 3, min_count=2)


@register("cross_department", O.cross_department(1.1, 30))
def _cross(ds):
    return patterns.cross_department(ds, min_lift=1.1, min_count=30,
                                     digits={"confidence": RAW, "lift": RAW})


# ----------------------------------------------------------------- O29, O30
@register("pair_labels", O.pair_labels(60))
def _pair_labels(ds):
    return views.pair_labels(ds, 60, limit=30, digits=RAW, view=None)


@register("assoc_view_2", O.assoc_view(2, 30, 30))
def _assoc2(ds):
    return views.associations(ds, 2, 30, min_co=30, digits=RAW, view=False)


@register("assoc_view_3", O.assoc_view(3, 5, 30))
def _assoc3(ds):
    return views.associations(ds, 3, 30, min_co=5, digits=RAW, view=False)


@register("assoc_view_4", O.assoc_view(4, 2, 30))
def _assoc4(ds):
    return views.associations(ds, 4, 30, min_co=2, digits=RAW, view=False)


# ----------------------------------------------------------------- O26, O3-O6
@register_dirty("basket_composition", O.basket_composition())
def _composition(ds):
    return composition.basket_sizes(ds, digits={"diversity_ratio": 9})


@register("weekday", O.weekday())
def _weekday(ds):
    return explore.orders_by_weekday(ds)


@register("hours", O.hours())
def _hours(ds):
    return explore.orders_by_hour(ds)


@register_dirty("top_departments", O.top_departments(10))
def _top_departments(ds):
    return explore.top_departments(ds, 10)


@register_dirty("quality", O.quality())
def _quality(ds):
    return quality.check(ds)


# ----------------------------------------------------------------- O7-O9
@register("baskets_by_name", O.baskets_by_name())
def _baskets_by_name(ds):
    return baskets.by_name(ds, view=None).select("order_id", F.array_join("items", "|").alias("items"))


@register("market_baskets", O.market_baskets())
def _market_baskets(ds):
    mb = baskets.market_baskets(ds, view=None)
    return mb.select("order_id", "user_id", F.array_join("products", "|").alias("products"),
                     F.array_join(F.col("product_ids").cast("array<string>"), ",").alias("product_ids"),
                     "basket_size")


@register("transactions", O.transactions())
def _transactions(ds):
    return baskets.transactions(ds).select("order_id", F.array_join("items", ",").alias("items"))


# ----------------------------------------------------------------- O11-O14
FP = AnalysisConfig(min_support=0.001, min_confidence=0.05, min_lift=1.0, max_transactions=None)


def _mined(ds):
    return rules.mine_dataset(ds, FP)


@register("fpgrowth_itemsets", O.fpgrowth_itemsets(FP.min_support))
def _fp_itemsets(ds):
    itemsets_df, _, _ = _mined(ds)
    return itemsets_df.select(F.array_join(F.array_sort("items"), ",").alias("items"),
                              F.size("items").alias("size"), "freq")


@register("itemsets_size_2", O.itemsets_of_size(FP.min_support, 2))
def _fp_size2(ds):
    itemsets_df, _, _ = _mined(ds)
    return rules.of_size(itemsets_df, 2).select(
        F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@register("fpgrowth_rules", O.fpgrowth_rules(FP.min_support, FP.min_confidence, FP.min_lift))
def _fp_rules(ds):
    _, rules_df, _ = _mined(ds)
    return rules_df.select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"),
                           F.array_join("consequent", ",").alias("consequent"),
                           "confidence", "lift", "support")


@register("rules_named", O.rules_named(FP.min_support, FP.min_confidence, FP.min_lift))
def _rules_named(ds):
    _, rules_df, _ = _mined(ds)
    named = rules.with_names(rules_df, ds)
    aligned = F.transform(F.array_sort(F.arrays_zip("antecedent_ids", "antecedent_names")),
                          lambda x: F.concat_ws(":", x["antecedent_ids"], x["antecedent_names"]))
    return named.select(F.array_join(aligned, " + ").alias("antecedent"),
                        F.array_join("consequent_names", " + ").alias("consequent"),
                        "confidence", "lift", "support")


# ----------------------------------------------------------------- O21-O23
USER = 0


@register("user_history", O.user_history(USER))
def _history(ds):
    return recommend.history(ds, USER)


@register("recommendations", O.recommendations(USER, 10))
def _recommendations(ds):
    return recommend.for_user(ds, USER, 10)


@register("recommend_many", O.recommend_many(10))
def _recommend_many(ds):
    return recommend.for_users(ds, ds.orders.select("user_id").distinct(), 10)


@register("rec_quality", O.rec_quality(10))
def _rec_quality(ds):
    out = evaluate.precision_recall(ds, 10)
    return out.select("total_users", "avg_correct_predictions",
                      F.round("avg_precision", 9).alias("avg_precision"),
                      F.round("avg_recall", 9).alias("avg_recall"))


# ----------------------------------------------------------------- top-k reports
@register("top_rules", O.top_rules(FP.min_support, FP.min_confidence, FP.min_lift, 20))
def _top_rules(ds):
    _, rules_df, _ = _mined(ds)
    return rules.top(rules_df, "lift", 20).select(
        F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"),
        F.array_join("consequent", ",").alias("consequent"), "confidence", "lift", "support")


@register("fp_triplets_top20", O.itemsets_of_size_top(FP.min_support, 3, 20))
def _fp_triplets(ds):
    itemsets_df, _, _ = _mined(ds)
    return rules.of_size(itemsets_df, 3, 20).select(
        F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@register("temporal_weekend_evening",
          O.temporal_slice(2, 5, "Weekend", "Evening (6-9pm)", 15))
def _weekend_evening(ds):
    return patterns.temporal(ds, 2, min_count=5, limit=15, time_period="Evening (6-9pm)", day_type="Weekend")


@register("quick_pairs", O.itemsets(2, 30, limit=100))
def _quick_pairs(ds):
    return itemsets.pairs(ds, min_co=30, limit=100, digits=RAW)


@register("quick_triplets", O.itemsets(3, 5, limit=100))
def _quick_triplets(ds):
    return itemsets.triplets(ds, min_co=5, limit=100, digits=RAW)


@register("quick_quadruplets", O.itemsets(4, 2, limit=100))
def _quick_quads(ds):
    return itemsets.quadruplets(ds, min_co=2, limit=100, digits=RAW)


# ----------------------------------------------------------------- sparse fixture, CSV round trip
@register_part("part_pairs", O.itemsets(2, 2, grain="part"))
def _part_pairs(ds):
    return itemsets.analyze(ds, 2, min_co=2, limit=None, digits=RAW)


@register_part("part_baskets_by_name", O.baskets_by_name(grain="part"))
def _part_baskets(ds):
    return baskets.by_name(ds, view=None).select("order_id", F.array_join("items", "|").alias("items"))


@register_part("part_sequential", O.sequential(2, grain="part"))
def _part_sequential(ds):
    return patterns.sequential(ds, min_count=2, digits=RAW)


@register("csv_temporal", O.temporal(2, 10))
def _csv_temporal(ds):
    """Tables written as CSV with further columns and another order, read back by header."""
    root = scratch_path(ds.orders.sparkSession, "csv")
    tables = ds.tables() | {"orders": ds.orders.select(
        "user_id", "order_id", "eval_set", F.lit(7).alias("order_number"), "order_dow", "order_hour_of_day",
        F.lit(None).cast("double").alias("days_since_prior_order"))}
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{root}/{ingest.CSV_FILES[name]}")
    return patterns.temporal(ingest.read_csv(ds.orders.sparkSession, root), 2, min_count=10)


@register("rule_predictions", O.rule_predictions(FP.min_support, FP.min_confidence))
def _predictions(ds):
    """What the rules predict for every transaction that some rule speaks to."""
    tx = baskets.transactions(ds, FP.max_transactions)
    _, _, mined = rules.mine_dataset(ds, FP)
    return (mined.transform(tx).where(F.size("prediction") > 0)
            .select("order_id", F.array_join("prediction", ",").alias("prediction")))


@register("load_quarantine", O.load_quarantine())
def _load_quarantine(ds):
    """Orders written as CSV with some unreadable numbers, loaded with a report: the quarantined rows by column."""
    spark = ds.orders.sparkSession
    root, target = scratch_path(spark, "csv"), scratch_path(spark, "loaded")
    spoiled = ds.orders.withColumns({
        "order_dow": F.when(F.col("order_id") % 10 == 3, F.lit("day")).otherwise(F.col("order_dow").cast("string")),
        "order_hour_of_day": F.when(F.col("order_id") % 15 == 3, F.lit("7h")).otherwise(F.col("order_hour_of_day").cast("string"))})
    for name, df in (ds.tables() | {"orders": spoiled}).items():
        df.write.option("header", True).csv(f"{root}/{ingest.CSV_FILES[name]}")
    _, report = ingest.load_csv(spark, root, target)
    rows = report.quarantine("orders")
    return rows.select("order_id", F.array_join("columns", ",").alias("columns"), F.col("_raw.order_dow").alias("raw_dow"),
                       F.col("_raw.order_hour_of_day").alias("raw_hour"), "order_dow", "order_hour_of_day",
                       F.lit(report.counts["orders"]["order_dow"]).cast("long").alias("lost_dow"),
                       F.lit(report.counts["orders"]["order_hour_of_day"]).cast("long").alias("lost_hour"))


def queries() -> Dict[str, QueryFn]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> Dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
