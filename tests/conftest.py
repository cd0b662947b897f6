import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sitescope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("sitescope-tests", "4", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows(frame):
    """Rows as dicts, in a stable order."""
    return sorted((r.asDict(recursive=True) for r in frame.collect()), key=repr)
