"""Result views: O29 pair labels, O30 labelled top associations, O31 registry."""

from __future__ import annotations

from typing import Dict, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.functions import labels as L
from basketlens.functions import metrics as M
from basketlens.operators import itemsets
from basketlens.operators.cooccur import basket_profile

# The reference's view names.
RESULT_VIEWS = {
    "pairs": "product_pairs_analysis",
    "triplets": "triplet_patterns",
    "quadruplets": "quadruplet_patterns",
    "temporal": "temporal_patterns",
    "cross_department": "cross_department_insights",
    "sequential": "sequential_patterns",
    "reorder": "reorder_patterns",
    "basket_composition": "basket_compositions",
}


def pair_labels(ds: Dataset, min_co_exclusive: int = 100, limit: Optional[int] = 30,
                digits: Optional[int] = 4, view: Optional[str] = "top_associations") -> DataFrame:
    """O29: 'name1 → name2', co > ``min_co_exclusive``, support; top by co."""
    sets = itemsets.counted_sets(ds, 2, min_co_exclusive + 1)
    total = F.lit(basket_profile(ds.order_products_prior).baskets)
    out = itemsets.named_top(ds, sets, 2, [F.desc("co_occurrence")], limit, [
        L.association_label(["product_1", "product_2"]).alias("product_pair"), "co_occurrence",
        M.rounded(M.support("co_occurrence", total), digits).alias("support")])
    if view:
        out.createOrReplaceTempView(view)
    return out


def associations(ds: Dataset, n: int = 2, limit: int = 30, min_co: int = 50,
                 digits=itemsets.DEFAULT_DIGITS, view: bool = True) -> DataFrame:
    """Top ``limit`` sets by lift with an ``association`` label (any n)."""
    top = itemsets.top(ds, n, "lift", limit, min_co=min_co, digits=digits)
    out = top.withColumn("association", L.association_label(itemsets.product_columns(n)))
    if view:
        out.createOrReplaceTempView(f"top_associations_{n}item")
    return out


def register_all(results: Dict[str, DataFrame], names: Dict[str, str] = RESULT_VIEWS) -> Dict[str, str]:
    """Publish each result under its view name; returns key -> view."""
    published = {}
    for key, df in results.items():
        view = names.get(key, key)
        df.createOrReplaceTempView(view)
        published[key] = view
    return published
