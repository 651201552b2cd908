"""The shared folder comes from the session; a local one is made in local mode only."""

from types import SimpleNamespace

import pytest

from wardline import session


def fake(master, root=None):
    conf = SimpleNamespace(get=lambda key, default=None: root or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_named_folder_wins():
    assert session.shared_root(fake("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.shared_root(fake("yarn"))


def test_local_folder_is_made_once():
    a = session.shared_root(fake("local[2]"))
    assert a == session.shared_root(fake("local[2]"))


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS `odd name (x)`")
    out = session.cut_lineage(df)
    assert out.schema.names == df.schema.names and sorted(out.collect()) == sorted(df.collect())
