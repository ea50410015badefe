import pytest

from tessera.session import build


@pytest.fixture(scope="session")
def spark():
    s = build(master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
