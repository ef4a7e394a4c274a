import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketlens.dataset import SCHEMAS, Dataset  # noqa: E402
from basketlens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", shuffle_partitions=4, driver_memory="4g",
                      conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bl-wh-")})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bl-ckpt-"))
    yield s


def make_ds(spark, baskets=None, *, orders=None, lines=None, train=None, products=None,
            aisles=None, departments=None):
    """Build a Dataset from Python rows.

    ``baskets``: {order_id: [product_id, ...]} -> prior orders of user 1,
    cart positions in list order.
    """
    if baskets is not None:
        orders = orders or [(o, 1, "prior", 1, 10) for o in baskets]
        lines = lines or [(o, p, i + 1, 0) for o, ps in baskets.items() for i, p in enumerate(ps)]
        ids = sorted({p for ps in baskets.values() for p in ps})
        products = products or [(p, f"item{p}", "1", "1") for p in ids]
    products = products if products is not None else []
    aisles = aisles if aisles is not None else [(1, "aisle one")]
    departments = departments if departments is not None else [(1, "dept one")]
    return Dataset.of(
        orders=spark.createDataFrame(orders or [], SCHEMAS["orders"]),
        order_products_prior=spark.createDataFrame(lines or [], SCHEMAS["order_products_prior"]),
        order_products_train=spark.createDataFrame(train or [], SCHEMAS["order_products_train"]),
        products=spark.createDataFrame(products, SCHEMAS["products"]),
        aisles=spark.createDataFrame(aisles, SCHEMAS["aisles"]),
        departments=spark.createDataFrame(departments, SCHEMAS["departments"]),
    )


@pytest.fixture(scope="session")
def tiny(spark):
    # A=1, B=2, C=3, D=4
    return make_ds(spark, {1: [1, 2], 2: [1, 2, 3], 3: [1], 4: [2, 3], 5: [1, 2, 3, 4]})


@pytest.fixture(scope="session")
def small(spark):
    from basketlens.sources.tpch import from_tpch
    return from_tpch(spark, SF_SMALL)
