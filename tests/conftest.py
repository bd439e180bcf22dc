import pytest

from arbor.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", shuffle_partitions=8)
    if s.sparkContext.getCheckpointDir() is None:
        import tempfile

        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return s
