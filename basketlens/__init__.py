"""basketlens: co-purchase analytics written as Spark DataFrame jobs.

The public surface is a handful of modules:

* ``basketlens.config``      -- validated analysis parameters
* ``basketlens.dataset``     -- the six-table order schema, cleaning, loading
* ``basketlens.sources``     -- CSV / catalog ingest, table and CSV sinks
* ``basketlens.functions``   -- reusable Column expressions (metrics, labels)
* ``basketlens.operators``   -- the analyses (item sets, rules, patterns, ...)
* ``basketlens.plans``       -- the end-to-end pipeline and the registered queries
"""

from basketlens.config import AnalysisConfig
from basketlens.dataset import Dataset

__all__ = ["AnalysisConfig", "Dataset"]
