import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402

# Declaring a schema from DDL needs a session, so it starts with collection.
_shared = tempfile.mkdtemp(prefix="tidemark-tests-")
_session = build_session(
    "tests", "local[4]",
    **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": os.path.join(_shared, "checkpoint"),
        "spark.sql.warehouse.dir": os.path.join(_shared, "warehouse"),
    },
)
_session.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield _session
    _session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
