"""Settled tables and the folder that they go to."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bindscape.functions import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _fake(master, application):
    conf = SimpleNamespace(get=lambda name, default=None: default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=application))


def test_local_mode_has_one_folder_an_application_and_a_cluster_needs_its_own():
    assert session.shared_dir(_fake("local[2]", "a")) == session.shared_dir(_fake("local[2]", "a"))
    assert session.shared_dir(_fake("local[2]", "a")) != session.shared_dir(_fake("local", "b"))
    with pytest.raises(ValueError):
        session.shared_dir(_fake("spark://host:7077", "c"))


def test_settled_tables_leave_the_setting_and_the_source_usable(spark):
    a = spark.range(1000).selectExpr("id % 7 AS k", "id")
    sums = a.groupBy("k").agg(F.sum("id").alias("x")).join(a, "k")
    want = sorted(map(tuple, sums.collect()))
    before = spark.conf.get(CLEANUP, None)
    settled = session.settle(sums)
    assert spark.conf.get(CLEANUP, None) == before
    assert settled.columns == sums.columns
    # what was written can be read, written and collected again
    assert sorted(map(tuple, settled.collect())) == want == sorted(map(tuple, session.settle(sums).collect()))
    assert sorted(map(tuple, sums.collect())) == want
