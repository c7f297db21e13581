import pytest

from mendframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, partitions=4, app="mendframe-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
