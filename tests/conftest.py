import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import session

    return session(8, partitions=3)


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("test tables are missing")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    from check import database

    return database(small)
