import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spectrafold.session import build_session  # noqa: E402
from spectrafold.shipping import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8, memory="8g", spark__ui__showConsoleProgress="false")
    ship(session)
    yield session
    session.stop()
