import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shiftlake.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 8, app="shiftlake-tests")
    yield s


@pytest.fixture()
def tmp_shared(spark):
    from shiftlake.session import scratch_path
    return scratch_path(spark, "tests")
