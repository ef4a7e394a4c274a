"""Exploration: O4 orders by weekday, O5 orders by hour, O6 top departments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.functions import labels as L


def orders_by_weekday(ds: Dataset) -> DataFrame:
    """Orders per ``order_dow`` with the weekday name (null for an unknown dow)."""
    return (ds.orders.groupBy("order_dow")
            .agg(F.count("order_id").alias("total_orders"))
            .orderBy(F.col("order_dow").asc_nulls_first())
            .select("total_orders", L.weekday_name("order_dow").alias("day_of_week")))


def orders_by_hour(ds: Dataset) -> DataFrame:
    return (ds.orders.groupBy("order_hour_of_day")
            .agg(F.count("order_id").alias("total_orders"))
            .orderBy(F.col("order_hour_of_day").asc_nulls_first())
            .select("total_orders", F.col("order_hour_of_day").alias("hour")))


def top_departments(ds: Dataset, limit: int = 10) -> DataFrame:
    """Departments by number of distinct products (numeric department ids only)."""
    return (ds.products_clean.select("product_id", "department_id")
            .join(ds.departments, "department_id")
            .groupBy("department")
            .agg(F.count_distinct("product_id").alias("products"))
            .orderBy(F.col("products").desc(), "department")
            .limit(limit))
