import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="ledgerline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def params():
    from ledgerline.params import Params

    return Params(distributor="Test Co", special_customers=("S1",), product_token="KX", token_mode="Y")
