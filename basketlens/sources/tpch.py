"""Derive the six order tables from the driver's TPC-H-style tables.

This is a data-preparation job (the real data arrives with its ids), written so
that every step is an aggregate or an equi-join -- no global or per-order
window -- and therefore splits across the cluster however skewed the keys are:

* item dictionary: one item per distinct ``p_name``; ``product_id`` = the smallest
  ``p_partkey`` carrying that name (``groupBy(p_name).min``)
* department / aisle: first / second word of the name; id = smallest
  ``product_id`` carrying that word, stored on the product as text
* orders: ``o_orderkey``, ``o_custkey``; ``eval_set`` = ``train`` for the user's
  last order by (``o_orderdate``, ``o_orderkey``), found with ``max(struct)``
  per user; ``order_dow`` Sunday = 0; ``order_hour_of_day`` = key mod 24
* lines: one row per (order, item); ``add_to_cart_order`` = the smallest
  ``l_linenumber`` of the item in the order (ties between items are possible,
  as in dirty cart data); ``reordered`` = 1 when the user bought the item in an
  earlier order: the rank of the order among those of (user, item) is above 1.
  A window holds what one user did with one item: a row for each order at most

``dirty=True`` replaces the department id of products whose id is a multiple
of 10, and the aisle id of multiples of 15, with the product name (text that is
not a number) to exercise the ``try_cast`` paths.

``grain="part"`` keeps every part an item of its own (id ``p_partkey``;
department ``p_type``, aisle ``p_brand``): sparse baskets, and names that many
items share.

The orders are computed once and written, as their lines and many analyses meet
them again.  So are the lines, parted by ``eval_set``; both line tables read that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.session import scratch_path, written


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_dictionary(part: DataFrame) -> DataFrame:
    return part.groupBy(F.col("p_name").alias("product_name")).agg(
        F.min("p_partkey").alias("product_id"))


def dirty_ids(products: DataFrame) -> DataFrame:
    """Some department and aisle ids replaced by text that is no number."""
    spoiled = lambda c, k: F.when(F.col("product_id") % k == 0, F.col("product_name")).otherwise(F.col(c))
    return products.withColumns({"department_id": spoiled("department_id", 10), "aisle_id": spoiled("aisle_id", 15)})


def from_tpch(spark: SparkSession, sf_dir: str, dirty: bool = False, grain: str = "name") -> Dataset:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    if grain == "part":
        items = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                            F.col("p_type").alias("department"), F.col("p_brand").alias("aisle"))
        part_item = part.select("p_partkey", F.col("p_partkey").alias("product_id"))
    else:
        items = item_dictionary(part).withColumns({
            "department": F.split_part("product_name", F.lit(" "), F.lit(1)),
            "aisle": F.split_part("product_name", F.lit(" "), F.lit(2)),
        })
        part_item = (part.join(item_dictionary(part), part.p_name == F.col("product_name"))
                     .select("p_partkey", "product_id"))
    departments = items.groupBy("department").agg(F.min("product_id").alias("department_id"))
    aisles = items.groupBy("aisle").agg(F.min("product_id").alias("aisle_id"))

    products = (
        items.join(departments, "department").join(aisles, "aisle")
        .select("product_id", "product_name",
                F.col("aisle_id").cast("string").alias("aisle_id"),
                F.col("department_id").cast("string").alias("department_id"))
    )
    if dirty:
        products = dirty_ids(products)

    raw_orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_ts"),
    )
    last = raw_orders.groupBy("user_id").agg(
        F.max(F.struct("order_ts", "order_id")).alias("_last"))
    seq_orders = written(raw_orders.join(last, "user_id").select(
        "order_id", "user_id", "order_ts",
        F.when(F.struct("order_ts", "order_id") == F.col("_last"), F.lit("train"))
        .otherwise(F.lit("prior")).alias("eval_set"),
        (F.dayofweek("order_ts") - 1).alias("order_dow"),
        (F.col("order_id") % 24).cast("int").alias("order_hour_of_day"),
    ), "orders")

    earlier = Window.partitionBy("user_id", "product_id").orderBy("order_ts", "order_id")
    lines = (
        _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        .join(part_item, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("order_id"), "product_id")
        .agg(F.min("l_linenumber").cast("int").alias("add_to_cart_order"))
        .join(seq_orders.select("order_id", "user_id", "order_ts", "eval_set"), "order_id")
        .withColumn("reordered", (F.rank().over(earlier) > 1).cast("int")))

    columns = ["order_id", "product_id", "add_to_cart_order", "reordered"]
    path = scratch_path(spark, "order-lines")
    lines.select("eval_set", *columns).write.partitionBy("eval_set").parquet(path)
    both = spark.read.schema(lines.select(*columns, "eval_set").schema).parquet(path)

    def split(name: str) -> DataFrame:
        return both.filter(F.col("eval_set") == name).select(*columns)

    return Dataset.of(
        orders=seq_orders,
        order_products_prior=split("prior"),
        order_products_train=split("train"),
        products=products,
        aisles=aisles,
        departments=departments,
    )
