"""Tables in the shared folder."""

from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest

from millrace import session


def test_durable_tables_are_read_back_and_dropped(spark):
    first = session.durable(spark.range(5), "first")
    assert first.count() == 5
    session.drop_written(spark)
    with pytest.raises(Exception, match="(?i)exist|found"):
        first.collect()


def test_a_scope_deletes_only_its_own(spark):
    outside = session.durable(spark.range(3), "outside")
    with session.Scope(spark) as outer:
        early = session.durable(spark.range(4), "early")
        with session.Scope(spark) as own:
            gone, kept = session.durable(spark.range(5), "same"), session.durable(spark.range(6), "same")
            own.drop(but_last=1)
        with ThreadPoolExecutor(1) as other:
            beside = other.submit(session.durable, spark.range(7), "beside").result()
        assert (early.count(), kept.count()) == (4, 6) and len(outer.paths) == 2
        outer.drop()
    after = session.durable(spark.range(8), "after")
    assert (outside.count(), beside.count(), after.count()) == (3, 7, 8)
    for frame in (gone, kept, early):
        with pytest.raises(Exception, match="(?i)exist|found"):
            frame.collect()


def test_a_cluster_needs_a_shared_folder():
    def fake(master, **settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: settings.get(k.rpartition(".")[2], d)), sparkContext=SimpleNamespace(master=master, applicationId="a"))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))
    assert session.shared_folder(fake("spark://host:7077", dir="hdfs://x/shared/")) == "hdfs://x/shared"
