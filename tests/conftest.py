import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def answer(spark, sf_dir):
    """A registered query's rows; each query is run once for all tests."""
    from gossamer import catalog

    catalog.load()
    known = {}

    def rows(name):
        if name not in known:
            known[name] = catalog.QUERIES[name](spark, sf_dir).toPandas()
        return known[name].copy()

    return rows


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
