import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltlog.session import utc_session  # noqa: E402
from siltlog.sources.formats import parse  # noqa: E402
from siltlog.sources.store import LogStore  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield utc_session(session)
    session.stop()


@pytest.fixture(scope="session")
def numbered(spark):
    """Lines numbered from 1."""

    def make(lines):
        return spark.createDataFrame(list(enumerate(lines, 1)), "line_number long, value string")

    return make


@pytest.fixture(scope="session")
def levels_table(spark):
    """A log table with the given levels, one row per second, one fingerprint per message."""

    def make(levels, messages=None):
        rows = [
            (i, f"log_{i + 1:05d}", level, (messages or levels)[i], (messages or levels)[i])
            for i, level in enumerate(levels)
        ]
        df = spark.createDataFrame(rows, "pos long, id string, level string, message string, fingerprint string")
        return df.selectExpr(
            "*", "message AS raw", "timestamp_seconds(1700000000 + pos) AS ts", "pos + 1 AS line_number"
        )

    return make


@pytest.fixture(scope="session")
def ingested(numbered):
    def make(lines, fmt="apache"):
        return LogStore.ingest(parse(numbered(lines), fmt))

    return make
