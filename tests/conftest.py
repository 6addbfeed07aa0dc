from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data")
    return str(path)


@pytest.fixture
def series(spark):
    """A function from {metric: values} to a series frame of one entity."""

    def make(data: dict[str, list[float]], entity: str = "e"):
        rows = [(entity, m, i, float(v)) for m, vs in data.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "entity string, metric string, seq int, value double")

    return make
