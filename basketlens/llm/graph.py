"""Joins and connected components in which no key is a hot task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.session import written

HOT_ROWS = 1_000      # rows of one key that a join keeps together
BITMAP_BYTES = 4096   # fixed: what bitmap_construct_agg returns


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key.

    ``rows`` must be cheap to read twice (a written table).  The rows of a key
    that has more than ``HOT_ROWS`` are dealt over parts, and its row of
    ``table`` is copied to each; copies are at most one per ``HOT_ROWS`` rows.
    ``how`` is ``inner`` or ``left``.
    """
    hot = written(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("_parts"))
                  .where("_parts > 1"), "hot")
    if hot.isEmpty():
        return rows.join(table, key, how)
    carried = [c for c in rows.columns if c != key]
    dealt = (rows.join(hot, key, "left")
             .withColumn("_part", F.floor(F.rand(7) * F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts"))
    copies = (table.join(hot, key, "left")
              .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts"))
    added = [c for c in table.columns if c != key]
    return dealt.join(copies, [key, "_part"], how).select(key, *carried, *added)


def hash_bits(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits (little) of the low ``bits`` bits of the hashes in ``column``: ``2**bits / 8`` bytes, whatever the rows."""
    page = 8 * BITMAP_BYTES
    spot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    pages = (rows.select(F.floor(spot / page).cast("int").alias("page"), (spot % page).alias("bit"))
             .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")))
    out = np.zeros(((1 << bits) // page, BITMAP_BYTES), np.uint8)
    for row in pages.toLocalIterator():
        out[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def components(links: DataFrame) -> DataFrame:
    """(fp, component) for the ends of ``links`` (a, b): the smallest reachable fp.

    Each round takes the least label among the neighbours and then the label of
    that label, so long chains shorten by half; every round is a written table.
    Ends with many links, and labels that many ends share, are split.
    """
    edges = written(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                     .withColumnRenamed("a", "fp"), "labels")
    while True:
        near = (join_hot(edges, labels.withColumnRenamed("fp", "b"), "b")
                .groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near")))
        lower = written(labels.join(near, "fp").select("fp", "label", F.least("label", "near").alias("least")), "lower")
        jump = labels.select(F.col("fp").alias("least"), F.col("label").alias("beyond"))
        fresh = written(join_hot(lower, jump, "least").select(
            "fp", F.least("least", "beyond").alias("label"),
            (F.least("least", "beyond") != F.col("label")).alias("moved")), "labels")
        labels = fresh.select("fp", "label")
        if fresh.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def smallest_ids(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``component_id``: the smallest doc_id of the component of the row's class.

    ``classes``: (fp, doc_id) with the smallest id of each class; ``labels``:
    (fp, component).  The smallest ids are found over classes, so a class costs
    one row there however many documents it has; ``rows`` and ``classes`` are
    written tables.
    """
    placed = written(classes.join(labels, "fp", "left")
                     .select("fp", "doc_id", F.coalesce("component", "fp").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = join_hot(placed.select("fp", "component"), least, "component").select("fp", "component_id")
    return join_hot(rows, of_class, "fp")
