import pytest

from siltstone.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4")
    s.sparkContext.setLogLevel("ERROR")
    return s
