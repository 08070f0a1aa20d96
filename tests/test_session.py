"""The shared scratch folder."""

import pytest

from loomwright.session import materialise, remove, shared_dir, sweep


def test_materialised_tables_can_be_removed(spark):
    df = materialise(spark.range(10), "numbers")
    files = df.inputFiles()
    assert df.count() == 10 and all(f.startswith(shared_dir(spark)) for f in files)
    remove(df)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_other_files_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    remove(df)
    assert df.count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Stub:
        class conf:
            get = staticmethod(lambda name, other: other)

        class sparkContext:
            master = "spark://h:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Stub)


def test_sweep_deletes_old_tables_only(spark):
    df = materialise(spark.range(3), "kept")
    assert sweep(spark, 1.0) == 0 and df.count() == 3
    assert sweep(spark, -1.0) >= 1
