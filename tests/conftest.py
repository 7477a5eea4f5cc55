import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    __spark_entry__.ship(session)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """A frame of one text column ``t`` with its position ``i``."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "i int, t string")

    return make


@pytest.fixture
def apply(texts):
    """Values of an expression over single texts, in order."""

    def run(expression, *values):
        rows = texts(*values).select("i", expression.alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
