"""O3 data-quality report and O3b gate."""

from __future__ import annotations

from typing import Tuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from basketlens.dataset import Dataset


def check(ds: Dataset) -> DataFrame:
    """One row: products, products whose department / aisle id is not a number,
    products with both ids numeric."""
    dept_ok = F.col("department_id").try_cast("bigint").isNotNull()
    aisle_ok = F.col("aisle_id").try_cast("bigint").isNotNull()
    return ds.products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count(F.when(~dept_ok, 1)).alias("invalid_dept_ids"),
        F.count(F.when(~aisle_ok, 1)).alias("invalid_aisle_ids"),
        F.count(F.when(dept_ok & aisle_ok, 1)).alias("valid_products"),
    )


def passes(report: Row) -> Tuple[bool, str]:
    bad = {side: report[f"invalid_{side}_ids"] for side in ("dept", "aisle")}
    if any(bad.values()):
        return False, (f"{bad['dept']} products without a numeric department id and {bad['aisle']} without a numeric "
                       "aisle id do not join their dimension")
    return True, "all product ids join"


def gate(ds: Dataset) -> Tuple[bool, str, Row]:
    """Run the one-row report (a bounded fetch) and judge it."""
    report = check(ds).first()
    ok, message = passes(report)
    return ok, message, report
