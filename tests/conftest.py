import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from filewright.session import local_session, ship_code

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session)
    yield session
    session.stop()
