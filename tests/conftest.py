import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarrylight.session import build_session

    return build_session("local[8]", 4)


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not present")
    return SMALL


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted(tuple(r) for r in df.collect())
