import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from kinfold.session import build_session

    session = build_session("tests", cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
