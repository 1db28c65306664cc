import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foliant.plans.session import build_session

    session = build_session("tests", 4, str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
