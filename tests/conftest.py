import pytest

from inquest.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()
