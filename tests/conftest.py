import pytest

from confab import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "8")
    yield s
    s.stop()
