import pytest

from strandlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", partitions=4, app="tests")
    yield session
    session.stop()
