import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from threadweave.session import local_session

    return local_session(cores="4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
