"""Tables that plans write and read again."""

import os

import pytest

from leafpress import scratch


def test_written_tables_end_lineage_and_can_be_released(spark):
    made = scratch.cut(spark.range(5).selectExpr("id", "array(id) AS a"))
    assert [tuple(r) for r in made.orderBy("id").collect()] == [(k, [k]) for k in range(5)]
    assert "Range" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert os.path.isdir(scratch.local_path(scratch.folder(spark)))
    scratch.release(spark)
    assert not os.path.exists(scratch.local_path(scratch.folder(spark)))


def test_paths():
    assert scratch.local_path("/a/b") == scratch.local_path("file:/a/b") == scratch.local_path("file:///a/b") == "/a/b"
    assert scratch.local_path("hdfs://host/a") is None


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[1,1,1024]", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    class Context:
        applicationId = "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    Session.sparkContext.master = master
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.folder(Session())
