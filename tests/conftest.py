import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from texmill.session import local_session  # noqa: E402
from texmill.storage import reachable  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    reachable(session)
    return session
