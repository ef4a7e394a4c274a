"""Upper bounds that keep sets out of a top-k before they are formed.

A set's count is at most the smallest support of its members, so the supports
alone bound its metrics:

* co-occurrence and support: by the smallest support
* lift = co * total^(n-1) / product of supports: by total^(n-1) / product of the
  other supports, each of which is at least ``min_co``

A few items that promise high values are ranked first.  The k-th best value
among their sets is a value that every set of the whole top-k reaches, so items
whose bound stays below it can be in none of them: their lines are left out.
Bounds are exact or generous by the rounding, so ties are all kept.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.session import written

SEED_ITEMS = 256      # items ranked first; with fewer than four times as many there is nothing to gain


def seeds(supports: DataFrame, most_frequent: bool) -> Optional[DataFrame]:
    """(product_id) of the items ranked first, out of (product_id, support_count); None for a short list."""
    if supports.limit(4 * SEED_ITEMS).count() < 4 * SEED_ITEMS:
        return None
    order = F.desc("support_count") if most_frequent else F.asc("support_count")
    return written(supports.orderBy(order, "product_id").limit(SEED_ITEMS).select("product_id"), "seeds")


def kth_best(sets: DataFrame, metric: str, k: int) -> Optional[float]:
    """The ``k``-th highest value of ``metric``; None if there are fewer."""
    best = sets.select(metric).orderBy(F.desc(metric)).limit(k).collect()     # k values
    return best[-1][0] if k and len(best) == k else None


def rounding(value: float, digits: Optional[int]) -> float:
    """How far a value may lie below the one it is rounded to (or differ by the order of operations)."""
    return 1e-9 * abs(value) if digits is None else 10.0 ** -digits


def greatest_support(lift: float, total: int, n: int, min_co: int) -> float:
    """The support above which an item is in no n-set of that lift."""
    return float("inf") if lift <= 0 else float(total) ** (n - 1) / (lift * float(max(1, min_co)) ** (n - 2))


def promising(supports: DataFrame, scored: Callable[[DataFrame], DataFrame], metric: str, limit: Optional[int], n: int,
              total: int, min_co: int, digits: Optional[int]) -> Optional[DataFrame]:
    """The items that can be in one of the ``limit`` best sets by ``metric`` (None: all).

    ``supports``: (product_id, support_count) of the items in question;
    ``scored(items)`` ranks the sets of some of them.
    """
    if limit is None or metric not in ("lift", "support", "co_occurrence"):
        return None
    first = seeds(supports, most_frequent=metric != "lift")
    if first is None:
        return None
    value = kth_best(scored(first), metric, limit)
    if value is None:
        return None
    value -= rounding(value, digits)
    if metric == "lift":
        able = F.col("support_count") <= greatest_support(value, total, n, min_co) * (1 + 1e-9)
    else:
        able = F.col("support_count") >= (value if metric == "co_occurrence" else value * total * (1 - 1e-9))
    return written(supports.where(able).select("product_id"), "promising")
