import pytest

from eventweave.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 4, "file://" + str(tmp_path_factory.mktemp("scratch")))
    s.sparkContext.setLogLevel("ERROR")
    return s
