import pytest

from marlstone.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("4", 4)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
