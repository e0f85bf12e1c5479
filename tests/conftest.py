import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("bindscape-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def split_everything(monkeypatch):
    """Force the many-bucket paths that otherwise need millions of rows."""
    from bindscape.functions import prefix

    monkeypatch.setattr(prefix, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(prefix, "POSITION_BUCKET", 64)
    monkeypatch.setattr(prefix, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(prefix, "SPLIT_PIECES", 7)
    monkeypatch.setattr(prefix, "SPLIT_ONE_IN", 2)
    monkeypatch.setattr(prefix, "SPLIT_MIN_PICKED", 3)


@pytest.fixture(params=["one_task", "split"])
def both_paths(request):
    if request.param == "split":
        request.getfixturevalue("split_everything")
    return request.param
