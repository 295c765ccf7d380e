import types

import pytest

from proofmark import runtime


def context(master, folder=None):
    conf = types.SimpleNamespace(get=lambda key: folder)
    return types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=lambda d: None)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(context(master))
    assert runtime.shared_folder(context(master, "/shared")) == "/shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local[4,2]"])
def test_one_process_may_make_its_own(master):
    assert "proofmark-" in runtime.shared_folder(context(master))


def test_written_tables_are_read_back_whole(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as s", "array(id, null) as a")
    assert sorted(map(tuple, runtime.checkpointed(df).collect())) == sorted(map(tuple, df.collect()))
