import pytest

from tessella.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
