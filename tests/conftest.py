import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathloom.session import HOT_ROWS_CONF, HOT_ROWS_DEFAULT, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4, "pathloom-tests")


@pytest.fixture
def hot(spark):
    """Set the number of rows one task may order, for one test."""

    def set_(rows):
        spark.conf.set(HOT_ROWS_CONF, str(rows))

    yield set_
    spark.conf.set(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT))
