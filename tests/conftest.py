import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from voxelweave.session import local_session, ship_package

    session = local_session("tests", cores="4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
