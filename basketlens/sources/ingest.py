"""O1 CSV ingest and O2 managed-table sink for the six order tables.

CSV files are read by their header and cast to the declared types (no
``inferSchema`` pass over the data).  The raw product ids stay text, as they
arrive.  ``load_csv`` does the same while it writes the tables, and reports
what the casts could not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Dict, Optional, Tuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketlens.dataset import SCHEMAS, TABLES, Dataset

# The input file name of each table.
CSV_FILES = {
    "aisles": "aisles.csv",
    "departments": "departments.csv",
    "order_products_prior": "order_products__prior.csv",
    "order_products_train": "order_products__train.csv",
    "orders": "orders.csv",
    "products": "products.csv",
}

LOOKUP_ROW_GROUP = 8 << 20   # bytes of a row group that a point lookup reads or skips


def read_csv(spark: SparkSession, base_path: str, files: Dict[str, str] = CSV_FILES) -> Dataset:
    """O1: the six headed CSV files under ``base_path`` as a ``Dataset``.

    Columns are bound by the names in each file's header, whatever their order
    and whatever else the file holds; every column is read as text (Spark reads
    only the header line for that) and the declared ones are cast.  A missing
    column raises; text that is no number becomes null.
    """
    tables = {}
    for name in TABLES:
        raw, columns = _raw(spark, base_path, files, name)
        tables[name] = raw.select(*[_cast(columns[f.name], f.dataType).alias(f.name) for f in SCHEMAS[name].fields])
    return Dataset.of(**tables)


def _raw(spark: SparkSession, base_path: str, files: Dict[str, str], name: str) -> Tuple[DataFrame, Dict[str, Column]]:
    """A file as text, and the column of each declared name."""
    path = f"{base_path.rstrip('/')}/{files[name]}"
    raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}
    missing = [f.name for f in SCHEMAS[name].fields if f.name not in known]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw, {f.name: F.col(f"`{known[f.name]}`") for f in SCHEMAS[name].fields}


def _cast(column: Column, data_type) -> Column:
    return column.try_cast(data_type)


@dataclass(frozen=True)
class LoadReport:
    """What a load found: per table the rows, and per column the values that are no number.

    ``counts[table]`` holds ``rows``, ``quarantined`` (rows with such a value)
    and one entry per cast column.
    """
    spark: SparkSession
    path: str
    counts: Dict[str, Dict[str, int]]

    @property
    def clean(self) -> bool:
        return not any(table["quarantined"] for table in self.counts.values())

    def quarantine(self, name: str) -> DataFrame:
        """The rows of a table with values that no cast could read: ``column``, the text as it came
        (a struct of all declared columns), and the row as it was loaded."""
        loaded = self.spark.read.schema(f"{_ddl(name)}, {RAW} struct<{_texts(name)}>, {DIRTY} boolean") \
            .parquet(f"{self.path}/{name}").where(F.col(DIRTY))
        lost = [F.when(F.col(f.name).isNull() & F.col(f"{RAW}.{f.name}").isNotNull(), F.lit(f.name))
                for f in SCHEMAS[name].fields]
        return loaded.select(F.array_compact(F.array(*lost)).alias("columns"), RAW,
                             *[f.name for f in SCHEMAS[name].fields])


RAW, DIRTY = "_raw", "_dirty"


def _ddl(name: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)


def _texts(name: str) -> str:
    return ", ".join(f"{f.name}: string" for f in SCHEMAS[name].fields)


def load_csv(spark: SparkSession, base_path: str, path: str,
             files: Dict[str, str] = CSV_FILES) -> Tuple[Dataset, LoadReport]:
    """O1 with a report: the CSV files, written as parquet under ``path`` in one pass each.

    A row with text that is no number is loaded with null there, as ``read_csv``
    does, and keeps its texts beside it in a partition of its own
    (``_dirty=true``), which is the quarantine.  The counts are observed by the
    job that writes: nothing is read twice.
    """
    counts: Dict[str, Dict[str, int]] = {}
    for name in TABLES:
        raw, columns = _raw(spark, base_path, files, name)
        fields = SCHEMAS[name].fields
        lost = {f.name: columns[f.name].isNotNull() & _cast(columns[f.name], f.dataType).isNull()
                for f in fields if f.dataType.simpleString() != "string"}
        dirty = reduce(or_, lost.values(), F.lit(False))
        seen = Observation(f"load {name}")
        observed = raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(dirty).alias("quarantined"),
                               *[F.count_if(is_lost).alias(c) for c, is_lost in lost.items()])
        texts = F.struct(*[columns[f.name].alias(f.name) for f in fields])
        (observed.select(*[_cast(columns[f.name], f.dataType).alias(f.name) for f in fields],
                         F.when(dirty, texts).alias(RAW), dirty.alias(DIRTY))
         .write.mode("overwrite").partitionBy(DIRTY).parquet(f"{path}/{name}"))
        counts[name] = {c: int(n) for c, n in seen.get.items()}
    return Dataset.from_parquet(spark, path), LoadReport(spark, path, counts)


def save_tables(ds: Dataset, database: Optional[str] = None, fmt: str = "parquet",
                partition_orders_by_eval_set: bool = False, order_buckets: Optional[int] = None) -> Dict[str, str]:
    """O2: overwrite one managed table per input table; returns name -> table.

    With ``order_buckets`` the orders and the line tables are dealt into that
    many buckets by ``order_id`` and sorted by it.  Read from the catalog, joins
    of lines with orders and groupings by order then need no exchange.
    """
    spark = ds.orders.sparkSession
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    written = {}
    for name, df in ds.tables().items():
        full = f"{database}.{name}" if database else name
        by_order = order_buckets and "order_id" in df.columns
        if by_order:      # one file a bucket
            df = df.repartition(order_buckets, "order_id")
        writer = df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true")
        if partition_orders_by_eval_set and name == "orders":
            writer = writer.partitionBy("eval_set")
        if by_order:
            writer = writer.bucketBy(order_buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(full)
        written[name] = full
    return written


def save_parquet(ds: Dataset, path: str, for_lookups: bool = False) -> str:
    """Write the six tables as parquet folders under ``path`` (read back with
    ``Dataset.from_parquet``).

    ``for_lookups`` serves questions about one user: orders are sorted by user
    and lines by order (a range of ids a file, so that row groups can be
    skipped by their bounds), and both carry Bloom filters of these ids.
    """
    for name, df in ds.tables().items():
        writer = df.write
        key = {"orders": "user_id", "order_products_prior": "order_id", "order_products_train": "order_id"}.get(name)
        if for_lookups and key:
            writer = (df.repartitionByRange(key).sortWithinPartitions(key).write
                      .option(f"parquet.bloom.filter.enabled#{key}", "true")
                      .option("parquet.block.size", LOOKUP_ROW_GROUP))
        writer.mode("overwrite").parquet(f"{path}/{name}")
    return path
