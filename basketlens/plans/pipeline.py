"""The full analysis as one call, returning lazy results by name.

``analysis`` is a context manager: the prior lines, read by almost every
analysis, are persisted while it is open.  Inside it ``export`` writes the
result tables under their own names.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace
from typing import Dict, Iterator, Optional

from pyspark.sql import DataFrame

from basketlens.config import AnalysisConfig
from basketlens.dataset import Dataset
from basketlens.operators import (baskets, composition, departments, evaluate, itemsets, patterns,
                                  quality, recommend, rules, views)
from basketlens.sources import sinks

# The table names of the exported results.
EXPORT_TABLES = {
    "pairs": "product_pairs_analysis",
    "triplets": "triplet_analysis",
    "quadruplets": "quadruplet_analysis",
    "temporal": "temporal_patterns",
    "cross_department": "cross_department_insights",
    "sequential": "sequential_patterns",
    "reorder": "reorder_patterns",
    "basket_composition": "basket_composition",
    "association_rules": "association_rules",
}


@contextmanager
def analysis(ds: Dataset, cfg: AnalysisConfig = AnalysisConfig(), search: str = "Banana",
             search_triplets: str = "Organic", user_id: Optional[int] = None, fpgrowth: bool = True,
             register_views: bool = True) -> Iterator[Dict[str, DataFrame]]:
    """All analyses of ``ds`` by name, with the lines cached for the block."""
    with baskets.cached(ds.order_products_prior) as prior:
        yield run(replace(ds, order_products_prior=prior), cfg, search, search_triplets, user_id,
                  fpgrowth, register_views)


def run(ds: Dataset, cfg: AnalysisConfig = AnalysisConfig(), search: str = "Banana",
        search_triplets: str = "Organic", user_id: Optional[int] = None, fpgrowth: bool = True,
        register_views: bool = True) -> Dict[str, DataFrame]:
    """As ``analysis``, without caching anything."""
    co = cfg.min_co_occurrence
    out: Dict[str, DataFrame] = {
        "quality": quality.check(ds),
        "baskets": baskets.by_name(ds, "baskets" if register_views else None),
        "market_baskets": baskets.market_baskets(ds, 2, "market_baskets" if register_views else None),
        "pairs": itemsets.analyze(ds, 2, co, 100),
        "triplets": itemsets.analyze(ds, 3, co, 100),
        "quadruplets": itemsets.analyze(ds, 4, max(1, co * 3 // 5), 50),
        "temporal": patterns.temporal(ds, 2, co),
        "cross_department": patterns.cross_department(ds, 2.5, 30),
        "sequential": patterns.sequential(ds, 80),
        "reorder": patterns.reorder(ds, 2, 100),
        "basket_composition": composition.basket_sizes(ds),
        "search_pairs": itemsets.search(ds, search, 2, co, 15),
        "search_triplets": itemsets.search(ds, search_triplets, 3, co, 10),
        "directed_pairs": itemsets.pairs_directed(ds, search, co, 20),
        "department_pairs": departments.associations(ds, 2, 1000),
        "department_triplets": departments.associations(ds, 3, 500),
        "department_confidence": departments.pairs_with_confidence(ds, 1000, 20),
        "pair_labels": views.pair_labels(ds, 100, view="top_associations" if register_views else None),
        "metrics": evaluate.precision_recall(ds),
    }
    for n, limit in ((2, 30), (3, 20), (4, 15)):
        out[f"associations_{n}"] = views.associations(ds, n, limit, min_co=co, view=register_views)
    if fpgrowth:
        freq, assoc, _ = rules.mine_dataset(ds, cfg)
        out["frequent_itemsets"] = freq
        out["association_rules"] = assoc
        out["rules_named"] = rules.with_names(assoc, ds)
        out["top_rules"] = rules.top(assoc, "lift", 20)
        out["fpgrowth_triplets"] = rules.of_size(freq, 3, 20)
    if user_id is not None:
        out["user_history"] = recommend.history(ds, user_id)
        out["recommendations"] = recommend.for_user(ds, user_id)
    if register_views:
        views.register_all({k: v for k, v in out.items() if k in views.RESULT_VIEWS})
    return out


def export(results: Dict[str, DataFrame], database: Optional[str] = None,
           csv_root: Optional[str] = None, staging: Optional[str] = None) -> Dict[str, dict]:
    """The batch export of a run: result tables and rules, as tables and (with
    ``csv_root``) as CSV folders.

    With ``staging``, a folder of its own, results are published only when all
    are written; after a failure the next export with that folder goes on where
    it stopped.
    """
    if staging:
        spark = next(iter(results.values())).sparkSession
        return sinks.StagedExport(spark, staging).run(results, EXPORT_TABLES, database, csv_root)
    return sinks.export_all(results, EXPORT_TABLES, database, csv_root)
