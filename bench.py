"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1), local[$BENCH_CPUS].

The six order tables are derived from the TPC-H-style input once and written
as parquet (the ingest step, timed separately as ``ingest_sec``); every query
then reads those tables and runs to completion through the ``noop`` sink.  Each
query gets a Dataset of its own, so nothing that one query prepares (basket
profile, supports) is free for the next.  Prints one JSON line.

Spark's JVM compiles its hot code paths during the first executions, so the
suite runs twice: the first pass (reported as ``cold_total_sec``) warms the
JVM, the second pass is the measurement (``queries``, ``value``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.dataset import Dataset  # noqa: E402
from basketlens.plans.registry import ON_DATASET  # noqa: E402
from basketlens.session import clear_scratch, local_session, scratch_path  # noqa: E402
from basketlens.sources.ingest import save_parquet  # noqa: E402
from basketlens.sources.tpch import dirty_ids, from_tpch  # noqa: E402

HEADLINE = [
    "itemset_pairs", "itemset_triplets", "itemset_quads", "itemset_search",
    "dept_pairs", "temporal_pairs", "sequential", "reorder_pairs", "cross_department",
    "basket_composition", "fpgrowth_rules", "recommendations", "rec_quality",
    "market_baskets",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)),
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    scratch = scratch_path(spark, "bench")

    t0 = time.time()
    clean = from_tpch(spark, sf_dir)
    save_parquet(clean, f"{scratch}/clean")
    # dirty ids only change the products; the other tables are the same
    save_parquet(replace(clean, products=dirty_ids(clean.products)), f"{scratch}/dirty")
    ingest = time.time() - t0

    def suite():
        times = {}
        for name in only:
            fn, needs_dirty = ON_DATASET[name]
            ds = Dataset.from_parquet(spark, f"{scratch}/{'dirty' if needs_dirty else 'clean'}")
            t0 = time.time()
            run(fn(ds))
            times[name] = round(time.time() - t0, 3)
        return times

    cold = suite()
    times = suite()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "ingest_sec": round(ingest, 3), "sf": sf,
                      "cold_total_sec": round(sum(cold.values()), 3),
                      "cpus": int(cpus)}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
