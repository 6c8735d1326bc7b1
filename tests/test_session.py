"""Session settings and the checkpoint folder."""

from types import SimpleNamespace

import pytest

from sylvara.session import checkpoint_folder, prepare


def fake(master, named=None):
    held = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held[-1] if held else None, setCheckpointDir=held.append, getConf=lambda: {"spark.checkpoint.dir": named})
    return SimpleNamespace(sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(fake(master))
    assert checkpoint_folder(fake(master, "hdfs://shared")) == "hdfs://shared"


def test_local_sessions_take_a_folder_of_their_own():
    one = fake("local[2]")
    assert checkpoint_folder(one) == checkpoint_folder(one) and "checkpoint-" in checkpoint_folder(one)


def test_unions_are_not_taken_as_partitioned(spark):
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    prepare(spark)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
