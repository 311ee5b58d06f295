"""Written tables and the shared folder."""

import os

import pytest

from gossamer import session


def test_materialized_tables_are_read_back_and_cleaned(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    df = session.materialize(spark.range(10).withColumnRenamed("id", "i"), "some")
    (uri,) = session._WRITTEN
    assert uri.startswith(session.shared_dir(spark)) and df.count() == 10
    assert session.clean(spark) == 1 and not os.path.exists(uri.removeprefix("file:")) and not session._WRITTEN


def test_workers_find_the_package(spark):
    session.prepare(session.prepare(spark))
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(session.ROOT) == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
