import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)
