import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from rekurve.plans.session import local_session

    return local_session("8", "8")


@pytest.fixture
def small_segments(spark):
    """Every group above 7 rows counts as hot."""
    from rekurve.operators.ordered import SEGMENT_CONF

    spark.conf.set(SEGMENT_CONF, "7")
    yield
    spark.conf.unset(SEGMENT_CONF)
