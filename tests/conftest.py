import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from riskspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", partitions=8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
