import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gateflow.session import local_session

    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
