"""n-item set analyses: O15 (any n), O16 directed pairs, O17 search, O18 top by
metric, and the quick pair / triplet / quadruplet entry points.

Semantics (per set of n distinct products bought in one prior order):

* ``co_occurrence`` = distinct orders holding all members (>= ``min_co``)
* ``support``       = co / distinct orders in the prior lines
* ``confidence``    = co / the smallest support count among members 1..n-1
* ``lift``          = co * total^(n-1) / product of the n support counts

Members are ordered by product id; names come from ``products`` (inner join).
Supports and the total come from all prior lines, exactly as the counts do.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import List, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.config import check_itemset_size
from basketlens.dataset import Dataset
from basketlens.functions import metrics as M
from basketlens.operators import bounds
from basketlens.operators.cooccur import (basket_profile, expanded_sets, itemset_counts, member_names, pinned,
                                          pinned_supports, top_rows, with_members)
from basketlens.operators.levelwise import frequent_levels

METRICS = ("lift", "support", "confidence", "co_occurrence")
EXPANDED_PER_LINE = 32   # n-subsets a line of a basket stands for, above which sets are formed level by level
DEFAULT_DIGITS = {"support": 6, "confidence": 4, "lift": 4}


def product_columns(n: int) -> List[str]:
    return [f"product_{i}" for i in range(1, n + 1)]


def counted_sets(ds: Dataset, n: int, min_co: int, count_col: str = "co_occurrence",
                 pattern: Optional[str] = None, prune: bool = True, items: Optional[DataFrame] = None) -> DataFrame:
    """(item_i, ``_s{i}`` supports, count) of sets of known products.

    Lines of products that ``products`` doesn't name are left out first, which
    is what joining the names to the sets would do.  With ``pattern`` only sets
    with a member name ``LIKE '%pattern%'`` are made: names are matched on
    ``products``, and the match travels with the item.  ``items`` (product_id)
    leaves only sets of these.

    Pairs, and larger sets of small baskets, are listed from the baskets.  Where
    that would list more than ``EXPANDED_PER_LINE`` sets a line (baskets of 100
    items hold 161,700 triplets each), sets of three and more are formed from
    frequent smaller ones instead (``levelwise``); the rows are the same.
    """
    lines = ds.order_products_prior
    supports = pinned_supports(lines)
    known = ds.products.select("product_id", "product_name")
    hit = F.lit(True) if pattern is None else F.coalesce(F.col("product_name").like(f"%{pattern}%"), F.lit(False))
    tagged = pinned(supports.where(F.col("support_count") >= (min_co if prune else 1))
                    .join(known, "product_id").groupBy("product_id").agg(F.max(hit).alias("_hit")))
    if items is not None:
        tagged = tagged.join(items, "product_id", "left_semi")
    known_lines = lines.join(tagged, "product_id")
    if n >= 3 and prune and min_co > 1 and _expands(lines, n):
        sets = _by_levels(ds, known_lines, tagged, n, min_co, count_col, pattern is not None)
    else:
        sets = itemset_counts(known_lines, n, min_count=min_co, prune=False, count_col=count_col,
                              profile_lines=lines, tag="_hit", keep=lambda hits: reduce(or_, hits),
                              known=tagged)
    return with_members(sets, n, supports, "product_id", {"support_count": "_s{i}"})


def _expands(lines: DataFrame, n: int) -> bool:
    sets, count = expanded_sets(lines, n)
    return sets > EXPANDED_PER_LINE * count


def _by_levels(ds: Dataset, lines: DataFrame, tagged: DataFrame, n: int, min_co: int, count_col: str,
               only_hits: bool) -> DataFrame:
    def with_hit(found: DataFrame, members: List[str]) -> DataFrame:
        columns = found.columns
        flagged = with_members(found, n, tagged, "product_id", {"_hit": "_h{i}"})
        return flagged.where(reduce(or_, [F.col(f"_h{i}") for i in range(1, n + 1)])).select(*columns)

    supports = pinned_supports(ds.order_products_prior).join(tagged, "product_id", "left_semi")
    levels = frequent_levels(lines, min_co, n, baskets=basket_profile(ds.order_products_prior).baskets,
                             profile_lines=ds.order_products_prior, supports=supports, count_col=count_col,
                             last=with_hit if only_hits else None)
    if len(levels) < n:
        schema = ", ".join(f"{m} long" for m in member_names(n)) + f", {count_col} long"
        return lines.sparkSession.createDataFrame([], schema)
    return levels[n - 1]


def scored_itemsets(ds: Dataset, n: int, min_co: int, digits: Optional[dict] = DEFAULT_DIGITS,
                    prune: bool = True, pattern: Optional[str] = None, items: Optional[DataFrame] = None) -> DataFrame:
    """Unordered, unlimited O15 rows by product id: item_i, co_occurrence and the metrics."""
    n = check_itemset_size(n)
    digits = digits or {}
    total = F.lit(basket_profile(ds.order_products_prior).baskets)
    s = [f"_s{i}" for i in range(1, n + 1)]
    return counted_sets(ds, n, min_co, pattern=pattern, prune=prune, items=items).select(
        *member_names(n), "co_occurrence",
        M.rounded(M.support("co_occurrence", total), digits.get("support")).alias("support"),
        M.rounded(M.confidence("co_occurrence", s[:-1]), digits.get("confidence")).alias("confidence"),
        M.rounded(M.lift("co_occurrence", total, s), digits.get("lift")).alias("lift"),
    )


def named_top(ds: Dataset, sets: DataFrame, n: int, order: Sequence[Column], limit: Optional[int],
              columns: Sequence[str]) -> DataFrame:
    """The first ``limit`` sets in ``order`` (ties by product ids), named after the cut."""
    order = [*order, *[F.col(m).asc() for m in member_names(n)]]
    kept = top_rows(sets, order, limit)
    named = with_members(kept, n, ds.products, "product_id", {"product_name": "product_{i}"})
    return named.orderBy(*order).select(*columns)


def analyze(ds: Dataset, n: int, min_co: int = 50, limit: Optional[int] = 100,
            digits: Optional[dict] = DEFAULT_DIGITS, prune: bool = True) -> DataFrame:
    """N-item sets ordered by lift, co-occurrence (then ids), top ``limit``."""
    return named_top(ds, scored_itemsets(ds, n, min_co, digits, prune), n,
                     [F.desc("lift"), F.desc("co_occurrence")], limit, _columns(n))


def _columns(n: int) -> List[str]:
    return [*product_columns(n), "co_occurrence", "support", "confidence", "lift"]


def pairs(ds: Dataset, min_co: int = 50, limit: Optional[int] = 100, **kw) -> DataFrame:
    """O33 quick pairs."""
    return analyze(ds, 2, min_co, limit, **kw)


def triplets(ds: Dataset, min_co: int = 30, limit: Optional[int] = 100, **kw) -> DataFrame:
    """O34 quick triplets."""
    return analyze(ds, 3, min_co, limit, **kw)


def quadruplets(ds: Dataset, min_co: int = 20, limit: Optional[int] = 100, **kw) -> DataFrame:
    """O35 quick quadruplets."""
    return analyze(ds, 4, min_co, limit, **kw)


def search(ds: Dataset, pattern: str, n: int = 2, min_co: int = 50, limit: Optional[int] = 20,
           digits: Optional[dict] = DEFAULT_DIGITS) -> DataFrame:
    """N-item sets where any member name is ``LIKE '%pattern%'``."""
    return named_top(ds, scored_itemsets(ds, n, min_co, digits, pattern=pattern), n,
                     [F.desc("lift"), F.desc("co_occurrence")], limit, _columns(n))


def pairs_directed(ds: Dataset, pattern: str, min_co_exclusive: int = 50, limit: Optional[int] = 20,
                   digits: Optional[int] = 4) -> DataFrame:
    """Pairs with co > ``min_co_exclusive`` and a member name like the pattern;
    both item counts, both confidences and lift; top ``limit`` by lift."""
    total = F.lit(basket_profile(ds.order_products_prior).baskets)
    co = "co_occurrence_count"
    sets = counted_sets(ds, 2, min_co_exclusive + 1, co, pattern).select(
        "item_1", "item_2", co, F.col("_s1").alias("product1_count"), F.col("_s2").alias("product2_count"),
        M.rounded(M.confidence(co, ["_s1"]), digits).alias("confidence_1_to_2"),
        M.rounded(M.confidence(co, ["_s2"]), digits).alias("confidence_2_to_1"),
        M.rounded(M.lift(co, total, ["_s1", "_s2"]), digits).alias("lift"))
    return named_top(ds, sets, 2, [F.desc("lift")], limit, [
        "product_1", "product_2", co, "product1_count", "product2_count", "confidence_1_to_2", "confidence_2_to_1", "lift"])


def top(ds: Dataset, n: int = 2, metric: str = "lift", limit: int = 30, min_co: int = 50,
        pool: Optional[int] = None, digits: Optional[dict] = DEFAULT_DIGITS) -> DataFrame:
    """The ``limit`` best of all sets by ``metric``.  ``pool`` is an explicit
    pre-selection: only that many sets, the best by lift, are ranked.

    By lift, support and co-occurrence only items that can be in one of those
    sets are looked at (``bounds``); confidence has no such bound."""
    if metric not in METRICS:
        raise ValueError(f"{metric!r} is none of {', '.join(METRICS)}")
    items = None
    if pool is None:
        supports = pinned_supports(ds.order_products_prior).where(F.col("support_count") >= min_co)
        items = bounds.promising(supports, lambda some: scored_itemsets(ds, n, min_co, digits, items=some), metric, limit, n,
                                 basket_profile(ds.order_products_prior).baskets, min_co, (digits or {}).get(metric))
    sets = scored_itemsets(ds, n, min_co, digits, items=items)
    by_lift = [F.desc("lift"), F.desc("co_occurrence")]
    if pool is not None:
        sets = top_rows(sets, [*by_lift, *[F.col(m).asc() for m in member_names(n)]], pool)
    return named_top(ds, sets, n, [F.desc(metric), *by_lift], limit, _columns(n))
