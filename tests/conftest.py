import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankwell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_DRIVER_MEMORY", "6g")
    session = build_session("tests", cpus=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def apply(spark):
    """Values of one string column through a column function."""

    def run(values, fn):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, v string")
        return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return run
