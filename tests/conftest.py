import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from check import connect  # noqa: E402

from recordmill import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "recordmill-tests", "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.fixture
def column(spark):
    """Values of an expression over a list of strings."""
    def run(expression, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]

    return run
