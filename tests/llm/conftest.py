import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pagelake.session import get_spark

    return get_spark(master="local[4]", shuffle_partitions=4, app_name="pagelake-tests")
