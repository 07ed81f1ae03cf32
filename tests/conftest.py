import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from assaylens.session import drop_materialised, ship_package

    ship_package(session)
    yield session
    drop_materialised(session)
    session.stop()


@pytest.fixture
def tiny_groups(spark, monkeypatch):
    """Force the paths for large tables: twenty rows to an ordered window, small join sides written."""
    monkeypatch.setattr("assaylens.session.LOOKUP_ROWS", 0)
    spark.conf.set("assaylens.groupRows", "20")
    yield
    spark.conf.unset("assaylens.groupRows")
