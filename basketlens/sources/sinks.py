"""O32 result export: managed table and CSV folder, both written by the cluster.

Spark's CSV writer takes no array columns, so arrays are joined to text
(``'|'`` between elements) first; the table sink keeps them as arrays.
"""

from __future__ import annotations

import json
import uuid
from typing import Dict, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_arrays(df: DataFrame, sep: str = "|") -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def to_table(df: DataFrame, name: str, database: Optional[str] = None, fmt: str = "parquet") -> str:
    full = f"{database}.{name}" if database else name
    df.write.mode("overwrite").format(fmt).saveAsTable(full)
    return full


def to_csv(df: DataFrame, path: str, header: bool = True) -> str:
    flatten_arrays(df).write.mode("overwrite").option("header", header).csv(path)
    return path


def export(df: DataFrame, name: str, database: Optional[str] = None, csv_path: Optional[str] = None,
           csv_root: Optional[str] = None) -> dict:
    """A managed table, and a CSV folder where ``csv_path`` (or ``csv_root``,
    the parent of a folder named after the table) says where; both may be any
    store Spark writes to."""
    out = {"table": to_table(df, name, database)}
    if csv_path or csv_root:
        out["csv"] = to_csv(df, csv_path or f"{csv_root.rstrip('/')}/{name}.csv")
    return out


def export_all(results: Dict[str, DataFrame], names: Dict[str, str], database: Optional[str] = None,
               csv_root: Optional[str] = None) -> Dict[str, dict]:
    """O32, batch form: every result that ``names`` knows, under its table name."""
    return {key: export(results[key], table, database, csv_root=csv_root)
            for key, table in names.items() if key in results}


class StagedExport:
    """O32, batch form, that can be stopped and continued.

    Every result is first written under ``folder`` (any store Spark writes to),
    and noted in a manifest when it is whole.  Only when all are noted are the
    tables (and CSV folders) published from there, so a run that fails leaves
    the old ones as they were.  A later run over the same ``folder`` writes
    what the manifest lacks; after publishing the folder is emptied.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def finished(self) -> Dict[str, str]:
        """Result name -> folder of the results that are whole."""
        if not self._fs.exists(self._path("manifest")):
            return {}
        notes = self.spark.read.text(f"{self.folder}/manifest").collect()     # one line per result
        return {note["result"]: note["path"] for note in (json.loads(r["value"]) for r in notes)}

    def write(self, name: str, df: DataFrame) -> str:
        """Stage one result; the note that it is whole follows its files."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        note = json.dumps({"result": name, "path": path})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/manifest")
        return path

    def run(self, results: Dict[str, DataFrame], names: Dict[str, str], database: Optional[str] = None,
            csv_root: Optional[str] = None) -> Dict[str, dict]:
        """Stage what is missing, publish all, empty the folder."""
        wanted = {key: table for key, table in names.items() if key in results}
        for key in wanted:
            if key not in self.finished():
                self.write(key, results[key])
        staged = self.finished()
        out = {key: export(self.spark.read.parquet(staged[key]), table, database, csv_root=csv_root)
               for key, table in wanted.items()}
        self._fs.delete(self._path(""), True)
        return out
