"""Department-level sets: O19 (any n) and O20 (pairs with confidence).

A department basket is the set of departments in a prior order (orders marked
``prior`` joined to their lines, products and departments; products whose
department id is not a number drop out).  Department sets are counted with the
same co-occurrence core as product sets, with the department name as item.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.config import check_itemset_size
from basketlens.dataset import Dataset
from basketlens.functions import metrics as M
from basketlens.operators.cooccur import (basket_profile, itemset_counts, member_names,
                                          pinned, top_rows, with_members)
from basketlens.session import written


def department_baskets(ds: Dataset) -> DataFrame:
    """Distinct (order_id, department) of the prior lines of prior orders, computed once.

    The baskets, their total and the orders holding a department all come from
    this table, which is much smaller than the lines.
    """
    names = pinned(ds.products_clean.select("product_id", "department_id")
                   .join(ds.departments, "department_id").select("product_id", "department"))
    lines = ds.prior_lines_of_prior_orders(basket_profile(ds.order_products_prior))
    return written(lines.select("order_id", "product_id").join(names, "product_id")
                   .select("order_id", "department").distinct(), "departments")


def _holding(lines: DataFrame) -> DataFrame:
    """(department, _holding): the baskets of each department; the lines of ``department_baskets`` are distinct."""
    return pinned(lines.where(F.col("department").isNotNull()).groupBy("department")
                  .agg(F.count("order_id").alias("_holding")))


def associations(ds: Dataset, n: int = 2, min_co: int = 1000, limit: Optional[int] = 50,
                 digits: Optional[int] = 2) -> DataFrame:
    """Department n-sets with co >= ``min_co``; ``support_pct`` = co * 100 / baskets."""
    n = check_itemset_size(n)
    lines = department_baskets(ds)
    sets = itemset_counts(lines, n, item="department", min_count=min_co, count_col="co_occurrence",
                          item_counts=_holding(lines) if min_co > 1 else None)
    depts = [f"dept_{i}" for i in range(1, n + 1)]
    out = sets.select(
        *[F.col(m).alias(d) for m, d in zip(member_names(n), depts)], "co_occurrence",
        M.rounded(M.percent("co_occurrence", F.lit(basket_profile(lines).baskets)), digits).alias("support_pct"))
    return top_rows(out, [F.desc("co_occurrence"), *map(F.col, depts)], limit)


def pairs_with_confidence(ds: Dataset, min_co_exclusive: int = 1000, limit: Optional[int] = 20,
                          digits: Optional[dict] = None) -> DataFrame:
    """Department pairs with co > ``min_co_exclusive``;
    ``support_pct`` = (co / baskets) * 100, ``confidence_dept1_to_dept2`` =
    co / baskets holding dept1."""
    digits = digits or {}
    lines = department_baskets(ds)
    per_dept = _holding(lines)
    sets = itemset_counts(lines, 2, item="department", min_count=min_co_exclusive + 1,
                          count_col="co_occurrence", item_counts=per_dept)
    sets = with_members(sets, 1, per_dept, "department", {"_holding": "_holding"})
    support = M.as_double("co_occurrence") / M.as_double(F.lit(basket_profile(lines).baskets))
    out = sets.select(
        F.col("item_1").alias("dept1"), F.col("item_2").alias("dept2"), "co_occurrence",
        M.rounded(support * F.lit(100.0), digits.get("support_pct", 2)).alias("support_pct"),
        M.rounded(M.as_double("co_occurrence") / M.as_double("_holding"),
                  digits.get("confidence", 4)).alias("confidence_dept1_to_dept2"))
    return top_rows(out, [F.desc("co_occurrence"), F.col("dept1"), F.col("dept2")], limit)
