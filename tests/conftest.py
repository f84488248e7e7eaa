import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabprep.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not there")
    return DATA


@pytest.fixture(scope="session")
def cars(spark):
    """Gaps, ties, a constant, negatives."""
    rows = [
        (1, "ford", 18.0, 8, 12.0, -1.0, 7),
        (2, "fiat", None, 4, 19.5, 2.0, 7),
        (3, None, 24.0, 4, 15.0, None, 7),
        (4, "ford", 18.0, 6, 14.5, 4.0, 7),
        (5, "audi", 30.0, 4, None, -5.0, 7),
        (6, "fiat", 26.0, None, 21.0, 6.0, 7),
    ]
    return spark.createDataFrame(rows, "id int, car string, mpg double, cylinders bigint, acceleration double, delta double, same int")
