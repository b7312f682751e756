from types import SimpleNamespace

import pytest

from tallygrid.session import scratch_dir, stored


def session(master: str, folder: str | None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda key, default: settings.get(key, default), set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_lies_in_the_shared_folder():
    shared = session("yarn", "hdfs://shared/checkpoints/")
    first, second = scratch_dir(shared, "x"), scratch_dir(shared, "x")
    assert first.startswith("hdfs://shared/checkpoints/x-") and first != second


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        scratch_dir(session("yarn", None), "x")


def test_local_session_gets_a_folder_of_its_own():
    local = session("local[2]", None)
    first, second = scratch_dir(local, "x"), scratch_dir(local, "x")
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_stored_table_starts_at_its_files(spark):
    df = stored(spark.range(10).selectExpr("id * 2 AS x"), "test")
    assert sorted(r.x for r in df.collect()) == list(range(0, 20, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
