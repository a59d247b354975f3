import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loomwork.session import build_session

    s = build_session(4, "tests", shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """The value of an expression over one row of texts."""

    def value(expression, **columns):
        df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)) if columns else spark.range(1)
        return df.select(expression.alias("v")).collect()[0]["v"]

    return value
