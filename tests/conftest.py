import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, app="tests", spark__sql__shuffle__partitions="4")
    yield session


@pytest.fixture(scope="session")
def data_dir():
    return "/root/testdata/sf0.001"
