from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from lodestone.session import ship

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", base)
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.checkpoint.dir", f"{base}/checkpoints")
        .getOrCreate()
    )
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables() -> str:
    return TABLES
