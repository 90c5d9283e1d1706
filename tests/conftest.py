import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from statloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4, str(tmp_path_factory.mktemp("checkpoint")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
