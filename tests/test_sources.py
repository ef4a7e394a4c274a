"""Sources and sinks: CSV ingest, managed tables, CSV export, views, caching."""

import os
import tempfile

import pytest

from basketlens.dataset import TABLES, Dataset
from basketlens.operators import baskets, itemsets, views
from basketlens.plans import pipeline
from basketlens.config import AnalysisConfig
from basketlens.sources import ingest, sinks


def _write_csvs(root):
    files = {
        "aisles.csv": "aisle_id,aisle\n1,fresh fruits\n2,yogurt\n",
        "departments.csv": "department_id,department\n4,produce\n16,dairy eggs\n",
        "order_products__prior.csv": ("order_id,product_id,add_to_cart_order,reordered\n"
                                      "2,33120,1,1\n2,28985,2,1\n3,33120,1,0\n3,28985,2,0\n3,9327,3,0\n"),
        "order_products__train.csv": "order_id,product_id,add_to_cart_order,reordered\n1,49302,1,1\n",
        "orders.csv": ("order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,"
                       "days_since_prior_order\n2,1,prior,1,2,8,\n3,1,prior,2,3,7,15.0\n1,1,train,3,4,9,8.0\n"),
        "products.csv": ("product_id,product_name,aisle_id,department_id\n"
                         "33120,Organic Egg Whites,2,16\n28985,Michigan Organic Kale,1,4\n"
                         "9327,Garlic Powder,1,missing\n49302,Bulgarian Yogurt,2,16\n"),
    }
    for name, text in files.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(text)


def test_csv_ingest_tables_and_export(spark):
    root = tempfile.mkdtemp(prefix="bl-csv-")
    _write_csvs(root)
    ds = ingest.read_csv(spark, root)
    assert sorted(tuple(r) for r in ds.orders.collect()) == [
        (1, 1, "train", 4, 9), (2, 1, "prior", 2, 8), (3, 1, "prior", 3, 7)]
    assert ds.products.where("department_id = 'missing'").count() == 1
    assert ds.products_clean.where("department_id IS NULL").count() == 1

    written = ingest.save_tables(ds, "bl_test", partition_orders_by_eval_set=True)
    assert set(written) == set(TABLES)
    back = Dataset.from_catalog(spark, "bl_test")
    assert back.order_products_prior.count() == 5
    assert back.orders.where("eval_set = 'prior'").count() == 2

    pairs = itemsets.analyze(back, 2, 1, None)
    assert pairs.count() == 3
    out = sinks.export(pairs, "pairs_out", database="bl_test",
                       csv_path=os.path.join(root, "pairs_csv"))
    assert spark.table(out["table"]).count() == 3
    csv_back = spark.read.option("header", True).csv(out["csv"])
    assert csv_back.count() == 3 and "lift" in csv_back.columns

    mb = baskets.market_baskets(back, view=None)
    path = sinks.to_csv(mb, os.path.join(root, "baskets_csv"))
    row = spark.read.option("header", True).csv(path).where("order_id = '3'").first()
    assert row.products == "Organic Egg Whites|Michigan Organic Kale|Garlic Powder"


def test_csv_columns_by_name(spark):
    root = tempfile.mkdtemp(prefix="bl-csv-")
    _write_csvs(root)
    with open(os.path.join(root, "orders.csv"), "w") as f:
        f.write("order_hour_of_day,eval_set,order_number,user_id,order_dow,order_id\n23,prior,51,7,x,2\n0,prior,52,7,6,3\n")
    rows = sorted(tuple(r) for r in ingest.read_csv(spark, root).orders.collect())
    assert rows == [(2, 7, "prior", None, 23), (3, 7, "prior", 6, 0)]
    with open(os.path.join(root, "aisles.csv"), "w") as f:
        f.write("aisle_id,name\n1,x\n")
    with pytest.raises(ValueError, match="no column aisle"):
        ingest.read_csv(spark, root)


def test_parquet_round_trip_and_cache(spark, tiny):
    path = tempfile.mkdtemp(prefix="bl-pq-")
    ingest.save_parquet(tiny, path)
    back = Dataset.from_parquet(spark, path)
    assert back.order_products_prior.count() == tiny.order_products_prior.count()
    with baskets.cached(baskets.transactions(back)) as tx:
        assert tx.is_cached and tx.count() == 4
    assert not tx.is_cached


def test_views_and_pipeline(spark, tiny):
    cfg = AnalysisConfig(min_co_occurrence=1, min_support=0.2, min_confidence=0.5)
    with pipeline.analysis(tiny, cfg, search="item4", search_triplets="item3", user_id=1) as results:
        for key, view in views.RESULT_VIEWS.items():
            assert spark.table(view).count() == results[key].count()
        for n in (2, 3, 4):
            assert spark.table(f"top_associations_{n}item").count() == results[f"associations_{n}"].count() > 0
        assert results["pairs"].count() == 6
        assert results["search_triplets"].count() == 3 and results["directed_pairs"].count() == 0
        assert results["frequent_itemsets"].count() > 0
        assert results["recommendations"].count() == 0  # user 1 owns every item
        spark.sql("CREATE DATABASE IF NOT EXISTS bl_run")
        root = tempfile.mkdtemp(prefix="bl-export-")
        written = pipeline.export(results, "bl_run", root)
        assert {v["table"] for v in written.values()} == {f"bl_run.{t}" for t in pipeline.EXPORT_TABLES.values()}
        for key, where in written.items():
            n = results[key].count()
            assert spark.table(where["table"]).count() == n
            assert spark.read.option("header", True).csv(where["csv"]).count() == n
    assert not tiny.order_products_prior.is_cached
    labels = views.pair_labels(tiny, 1, view="top_associations")
    assert spark.table("top_associations").count() == labels.count() == 3


def test_config_validation():
    for bad in ({"min_support": 0}, {"min_support": 1}, {"min_confidence": 0},
                {"min_lift": -1}, {"min_co_occurrence": 0}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)


# -- load report ------------------------------------------------------------------

def test_load_report_of_a_dirty_csv(spark, monkeypatch):
    """Counts and rows of what no cast could read, from the pass that writes the tables."""
    root, out = tempfile.mkdtemp(prefix="bl-csv-"), tempfile.mkdtemp(prefix="bl-load-")
    _write_csvs(root)
    with open(os.path.join(root, "orders.csv"), "w") as f:
        f.write("order_id,user_id,eval_set,order_dow,order_hour_of_day\n2,1,prior,two,8\nx3,1,prior,3,99999999999\n"
                "4,,prior,,7\n5,2,train,1,1\n")
    reads = []
    kept = ingest._raw
    monkeypatch.setattr(ingest, "_raw", lambda *a: reads.append(a[-1]) or kept(*a))
    ds, report = ingest.load_csv(spark, root, out)
    assert sorted(reads) == sorted(TABLES)
    assert report.counts["orders"] == {"rows": 4, "quarantined": 2, "order_id": 1, "user_id": 0, "order_dow": 1,
                                       "order_hour_of_day": 1}
    assert report.counts["order_products_prior"]["rows"] == 5 and not report.clean
    assert not any(v for k, v in report.counts["products"].items() if k != "rows")      # raw product ids stay text
    same = ingest.read_csv(spark, root)
    for name, df in ds.tables().items():
        assert df.columns == same.tables()[name].columns
        assert sorted(map(str, df.collect())) == sorted(map(str, same.tables()[name].collect()))
    bad = {tuple(r["columns"]): (r["_raw"].asDict(), r["order_id"]) for r in report.quarantine("orders").collect()}
    assert bad.keys() == {("order_dow",), ("order_id", "order_hour_of_day")}
    assert bad["order_id", "order_hour_of_day"] == ({"order_id": "x3", "user_id": "1", "eval_set": "prior", "order_dow": "3",
                                                     "order_hour_of_day": "99999999999"}, None)
    assert report.quarantine("aisles").count() == 0
    scan = report.quarantine("orders")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_dirty" in scan      # the clean rows are not read


# -- table layout -----------------------------------------------------------------

def test_bucketed_tables_need_no_exchange(spark, small):
    from basketlens.operators import patterns
    from basketlens.operators.cooccur import join_baskets
    ingest.save_tables(small, "bl_buckets", order_buckets=4)
    back = Dataset.from_catalog(spark, "bl_buckets")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_baskets(back.order_products_prior, back.orders)
        grouped = back.order_products_prior.groupBy("order_id").agg({"product_id": "collect_set"})
        both = joined.groupBy("order_id", "user_id").count()
        for df in (joined, grouped, both, patterns.cart_positions(back)):
            assert "Exchange" not in plan(df) and "Bucketed: true" in plan(df)
        assert "Exchange" in plan(join_baskets(small.order_products_prior, small.orders))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(joined.collect()) == sorted(join_baskets(small.order_products_prior, small.orders).collect())
    assert itemsets.pairs(back, 3, None).collect() == itemsets.pairs(small, 3, None).collect()


def test_one_user_reads_few_rows(spark, monkeypatch):
    """Tables saved for lookups: the history of one user reads a small part of orders and lines."""
    from pyspark.sql import functions as F

    from basketlens.operators import recommend
    from tests.conftest import make_ds
    from dataclasses import replace
    monkeypatch.setattr(ingest, "LOOKUP_ROW_GROUP", 64 << 10)
    orders = spark.range(300_000).select(F.col("id").alias("order_id"), (F.xxhash64("id") % 5000 + 5000).alias("user_id"),
                                         F.lit("prior").alias("eval_set"), F.lit(1).alias("order_dow"),
                                         F.lit(2).alias("order_hour_of_day"))
    lines = spark.range(900_000).select((F.col("id") / 3).cast("long").alias("order_id"), (F.col("id") % 50 + 1).alias("product_id"),
                                        F.lit(1).alias("add_to_cart_order"), F.lit(0).alias("reordered"))
    ds = replace(make_ds(spark, {1: list(range(1, 51))}), orders=orders, order_products_prior=lines)
    path = ingest.save_parquet(ds, tempfile.mkdtemp(prefix="bl-lookup-"), for_lookups=True)
    back = Dataset.from_parquet(spark, path)

    def rows_read(df):
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())]

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mine = back.orders.where("user_id = 7000").select("order_id")
        assert mine.collect() and sum(rows_read(mine)) < 300_000 / 4
        found = recommend._lines_of(back, 7000)
        expected = ds.order_products_prior.join(ds.orders.where("user_id = 7000"), "order_id", "left_semi")
        assert sorted(found.collect()) == sorted(expected.collect()) and found.count() > 30
        one = back.order_products_prior.where(F.col("order_id").isin([1234, 200_000]))
        assert len(one.collect()) == 6 and sum(rows_read(one)) < 900_000 / 10
        gone = back.order_products_prior.where("order_id = 300001")
        assert gone.collect() == [] and sum(rows_read(gone)) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    expected = sorted(map(tuple, recommend.history(ds, 7000).collect()))
    assert sorted(map(tuple, recommend.history(back, 7000).collect())) == expected
    monkeypatch.setattr(recommend, "LOOKUP_ORDERS", 3)
    assert sorted(map(tuple, recommend.history(back, 7000).collect())) == expected


# -- staged export -----------------------------------------------------------------

def test_export_continues_after_a_failure(spark, monkeypatch):
    """Stopped after the third of four results: old tables are whole; a rerun writes only the rest, then publishes."""
    folder = tempfile.mkdtemp(prefix="bl-stage-") + "/export"
    names = {f"r{k}": f"stage_{k}" for k in range(4)}
    spark.sql("CREATE DATABASE IF NOT EXISTS bl_stage")
    sinks.export_all({f"r{k}": spark.range(2).toDF("old") for k in range(4)}, names, "bl_stage")
    results = {f"r{k}": spark.range(10 * k + 1).toDF("x") for k in range(4)}
    made, kept = [], sinks.StagedExport.write

    def failing(self, name, df, stop=True):
        if stop and name == "r3":
            df.write.parquet(f"{self.folder}/r3-half")       # files of a result that never got whole
            raise RuntimeError("lost")
        made.append(name)
        return kept(self, name, df)

    monkeypatch.setattr(sinks.StagedExport, "write", failing)
    with pytest.raises(RuntimeError):
        sinks.StagedExport(spark, folder).run(results, names, "bl_stage")
    assert made == ["r0", "r1", "r2"]
    assert all(spark.table(f"bl_stage.stage_{k}").columns == ["old"] for k in range(4))
    made.clear()
    monkeypatch.setattr(sinks.StagedExport, "write", lambda self, name, df: failing(self, name, df, stop=False))
    csv = tempfile.mkdtemp(prefix="bl-csv-")
    out = sinks.StagedExport(spark, folder).run(results, names, "bl_stage", csv)
    assert made == ["r3"]
    assert [spark.table(out[f"r{k}"]["table"]).count() for k in range(4)] == [1, 11, 21, 31]
    assert spark.read.option("header", True).csv(out["r2"]["csv"]).count() == 21
    assert not os.path.exists(folder)
    with pytest.raises(RuntimeError):       # a new run starts anew
        monkeypatch.setattr(sinks.StagedExport, "write", failing)
        sinks.StagedExport(spark, folder).run(results, names, "bl_stage")
    assert sorted(sinks.StagedExport(spark, folder).finished()) == ["r0", "r1", "r2"]


def test_tpch_orders_are_written_and_reordered_is_exact(spark, tmp_path):
    """Orders at the same moment or at none, repeated rows, null keys; orders are read from the written table."""
    from datetime import datetime
    from basketlens.sources.tpch import from_tpch
    day = lambda n: datetime(2024, 1, n) if n else None
    part = [(i, f"w{i} v{i}", "t", "b") for i in range(1, 4)] + [(4, "w1 v1", "t", "b"), (None, "w5 v5", "t", "b")]
    orders = [(1, 7, day(3)), (2, 7, day(3)), (3, 7, day(1)), (4, 7, day(9)), (5, 8, None), (6, 8, None), (7, 8, day(2)),
              (8, 8, day(5)), (8, 8, day(5)), (9, None, day(1)), (10, 9, day(1))]
    lines = [(o, p, n) for o, _, _ in set(orders) for n, p in enumerate((1, 1 + o % 3, 4, 2 + o % 2), 1)] + [(1, None, 9), (1, 99, 9)]
    for name, rows, schema in (("part", part, "p_partkey long, p_name string, p_type string, p_brand string"),
                               ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
                               ("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    ds = from_tpch(spark, str(tmp_path))
    assert not any(str(tmp_path) in file for file in ds.orders.inputFiles())

    item = {1: 1, 2: 2, 3: 3, 4: 1}
    when = {o: (u, (d is not None, d or day(1), o)) for o, u, d in orders if u is not None}
    bought = {}
    for o, p, _ in lines:
        if p in item and o in when:
            bought.setdefault((when[o][0], item[p]), set()).add(when[o][1])
    last = {u: max(w for x, w in when.values() if x == u) for u in (7, 8, 9)}
    want = {"prior": [], "train": []}
    for o, u, d in orders:
        for p in sorted({item[p] for x, p, _ in lines if x == o and p in item}):
            if u is not None:
                cart = min(n for x, q, n in lines if x == o and item.get(q) == p)
                want["train" if when[o][1] == last[u] else "prior"].append((o, p, cart, int(when[o][1] > min(bought[u, p]))))
    assert sorted(tuple(r) for r in ds.order_products_prior.collect()) == sorted(want["prior"])
    assert sorted(tuple(r) for r in ds.order_products_train.collect()) == sorted(want["train"])
    assert {r[3] for r in want["prior"]} == {0, 1}
