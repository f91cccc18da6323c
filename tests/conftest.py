import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pulsegrid.session import local_session

    session = local_session(4, shuffle_partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
