"""Kept tables, their folder, and the setting that holds while they are written."""

import os
from types import SimpleNamespace

import pytest

from graphloom import session


def test_kept_tables_go_when_they_are_released(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    one, two = (session.materialise(spark.range(n), "t") for n in (3, 4))
    path = lambda df: df._graphloom_path.removeprefix("file://")
    assert one.count() == 3 and two.count() == 4 and os.path.isdir(path(one))
    session.release(one)
    assert not os.path.exists(path(one)) and os.path.isdir(path(two))
    assert session.release_all(spark) >= 1 and not os.path.exists(path(two)) and session.release_all(spark) == 0
    with pytest.raises(ZeroDivisionError), session.small_batches(spark, 1 << 20):
        seen.append(spark.conf.get(key))
        1 / 0
    assert seen == ["1048576b"] and spark.conf.get(key) == before


def test_no_machine_local_folder_on_a_cluster():
    fake = lambda master, found: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: found), sparkContext=SimpleNamespace(master=master, applicationId=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError):
            session.shared_dir(fake(master, None))
        assert session.shared_dir(fake(master, "hdfs://shared/")) == "hdfs://shared"
    assert session.shared_dir(fake("local[4]", None)).startswith("file:///")
