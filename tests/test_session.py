import os
from types import SimpleNamespace

import pytest

from ledgerlens import session


def fake(master, setting=None):
    """A session that only has the settings that are read."""
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    context = SimpleNamespace(master=master, applicationId="app-test", getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(master))


def test_the_named_folder_is_used():
    assert session.shared_folder(fake("yarn", "hdfs://shared/")) == "hdfs://shared"


def test_one_machine_may_use_scratch():
    assert os.path.isdir(session.shared_folder(fake("local[2]")))


def test_partitioned_stage_is_not_sorted(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(name))), write(self, *a, **k))[1])
    before = spark.conf.get(name)
    # More values than files kept open, and null.
    rows = [(i, None if i % 13 == 12 else i % 13) for i in range(500)]
    staged = session.stage(spark.createDataFrame(rows, "i int, side int").coalesce(2), "sides", ("side",))
    assert sorted(map(tuple, staged.collect())) == rows
    assert seen[0] > 0 and spark.conf.get(name) == before
