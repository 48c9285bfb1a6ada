import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture()
def days():
    """n-th day of a fixed January."""
    return lambda n, month=1, year=2020: dt.date(year, month, n)
