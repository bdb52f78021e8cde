import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pixelspark.session import local_session, send_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    send_package(session)
    yield session
    session.stop()
