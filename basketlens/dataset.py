"""The six-table order schema and the ``Dataset`` that carries it.

Tables (declared, never inferred):

* ``orders``               order_id, user_id, eval_set, order_dow, order_hour_of_day
* ``order_products_prior`` order_id, product_id, add_to_cart_order, reordered
* ``order_products_train`` same columns; the held-out truth
* ``products``             product_id, product_name, aisle_id, department_id
                           (the two ids arrive as raw text and may not be numbers)
* ``aisles``               aisle_id, aisle
* ``departments``          department_id, department

``Dataset.products_clean`` holds the ids after ``try_cast`` to bigint (null when
the text is not a number); every dimension join uses the cleaned ids, so a dirty
id never raises under ANSI mode, it simply does not match.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Dict, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("eval_set", T.StringType()),
    T.StructField("order_dow", T.IntegerType()),
    T.StructField("order_hour_of_day", T.IntegerType()),
])
ORDER_LINES = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("add_to_cart_order", T.IntegerType()),
    T.StructField("reordered", T.IntegerType()),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("aisle_id", T.StringType()),
    T.StructField("department_id", T.StringType()),
])
AISLES = T.StructType([
    T.StructField("aisle_id", T.LongType()),
    T.StructField("aisle", T.StringType()),
])
DEPARTMENTS = T.StructType([
    T.StructField("department_id", T.LongType()),
    T.StructField("department", T.StringType()),
])

SCHEMAS: Dict[str, T.StructType] = {
    "orders": ORDERS,
    "order_products_prior": ORDER_LINES,
    "order_products_train": ORDER_LINES,
    "products": PRODUCTS,
    "aisles": AISLES,
    "departments": DEPARTMENTS,
}
TABLES = tuple(SCHEMAS)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns in order, cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Dataset:
    orders: DataFrame
    order_products_prior: DataFrame
    order_products_train: DataFrame
    products: DataFrame
    aisles: DataFrame
    departments: DataFrame

    # ---------------------------------------------------------------- loading
    @classmethod
    def of(cls, **tables: DataFrame) -> "Dataset":
        return cls(**{name: conform(tables[name], SCHEMAS[name]) for name in TABLES})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: Optional[str] = None) -> "Dataset":
        prefix = f"{database}." if database else ""
        return cls.of(**{name: spark.table(prefix + name) for name in TABLES})

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> "Dataset":
        return cls.of(**{name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
                         for name in TABLES})

    def tables(self) -> Dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    # ---------------------------------------------------------------- derived
    @property
    def products_clean(self) -> DataFrame:
        """products with numeric ids: ``try_cast`` to bigint, null if not a number."""
        return self.products.select(
            "product_id",
            "product_name",
            F.col("aisle_id").try_cast("bigint").alias("aisle_id"),
            F.col("department_id").try_cast("bigint").alias("department_id"),
        )

    @property
    def product_dims(self) -> DataFrame:
        """product_id -> name, department name, aisle name (left joins; null when unknown)."""
        return (
            self.products_clean
            .join(self.departments, "department_id", "left")
            .join(self.aisles, "aisle_id", "left")
            .select("product_id", "product_name", "department_id", "department",
                    "aisle_id", "aisle")
        )

    @property
    def prior_orders(self) -> DataFrame:
        return self.orders.filter(F.col("eval_set") == "prior")

    def prior_lines_of_prior_orders(self, profile=None) -> DataFrame:
        """Prior lines of orders marked ``prior`` (the filtered analyses); hot
        orders are joined apart (see ``operators.cooccur.join_baskets``)."""
        from basketlens.operators.cooccur import join_baskets
        return join_baskets(self.order_products_prior, self.prior_orders.select("order_id"),
                            how="left_semi", profile=profile)
