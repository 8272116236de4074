import pytest

from lumenspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, memory="4g", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
