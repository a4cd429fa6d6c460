from __future__ import annotations

import os
import tempfile

import pytest

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{folder}/shared",
        "spark.sql.warehouse.dir": f"{folder}/warehouse",
        "spark.local.dir": folder,
    }
    session = SparkSession.builder.master(f"local[{min(4, os.cpu_count() or 1)}]").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def medium():
    return MEDIUM


@pytest.fixture(scope="session")
def small():
    return SMALL
