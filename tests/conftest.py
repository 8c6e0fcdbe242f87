import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = {"0.001": "/root/testdata/sf0.001", "0.01": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def spark():
    from shopgauge.session import local_session
    s = local_session(cores="*", shuffle_partitions=8)
    yield s
