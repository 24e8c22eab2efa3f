import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqloom.session import build_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("seqloom-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
