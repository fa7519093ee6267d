import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loanlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def application(**values):
    """One canonical application row as a tuple in schema order."""
    from loanlens import schema as S

    return tuple(
        float(values[c]) if c in S.NUMERIC and values.get(c) is not None else values.get(c) for c in S.CANONICAL
    )


@pytest.fixture(scope="session")
def applications(spark):
    from loanlens import schema as S

    def make(*rows):
        return spark.createDataFrame([application(**r) for r in rows], S.APPLICATION_SCHEMA)

    return make
