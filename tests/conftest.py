import pytest

from pathwise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
