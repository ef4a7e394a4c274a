"""Shared folder of intermediate tables."""

import os
from types import SimpleNamespace

import pytest

from basketlens.session import checkpoint_dir, clear_scratch, scratch_path, shared_dir, written


def fake(master, configured=None, registered=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured),
                           sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: registered))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake(master))
    assert shared_dir(fake(master, "hdfs://n/ckpt/")) == "hdfs://n/ckpt"
    assert shared_dir(fake(master, None, "s3a://b/x")) == "s3a://b/x"


def test_written_tables_and_their_removal(spark):
    before = checkpoint_dir(spark)
    table = written(spark.range(5).selectExpr("id", "id * 2 AS twice"), "t")
    assert sorted(map(tuple, table.collect())) == [(i, 2 * i) for i in range(5)]
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert checkpoint_dir(spark) == before
    empty = written(spark.range(0), "t")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_clear_scratch(spark):
    path = scratch_path(spark, "gone")
    app = path.rsplit("/", 1)[0]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(app)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    other = SimpleNamespace(conf=spark.conf, _jvm=spark._jvm, _jsc=spark._jsc,
                            sparkContext=SimpleNamespace(master="local[1]", applicationId="test-clear",
                                                         getCheckpointDir=spark.sparkContext.getCheckpointDir))
    mine = scratch_path(other, "gone")
    spark.range(1).write.parquet(mine)
    clear_scratch(other)
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(mine))


def test_scope_deletes_what_was_written_in_it(spark):
    from basketlens.session import scratch_scope, written
    outside = written(spark.range(3).toDF("x"), "outside")
    with scratch_scope(spark) as paths:
        inner = written(spark.range(4).toDF("x"), "inner")
        kept = written(spark.range(5).toDF("x"), "kept")
        assert inner.count() == 4 and len(paths) == 2
        paths.pop()
    assert outside.count() == 3 and kept.count() == 5
    assert not os.path.exists(paths[0].removeprefix("file:"))
    try:
        with scratch_scope(spark) as paths:
            written(spark.range(1).toDF("x"), "failed")
            raise KeyError
    except KeyError:
        pass
    assert not os.path.exists(paths[0].removeprefix("file:"))
