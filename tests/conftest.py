import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marrow.session import build_session
    s = build_session("local[4]", 4, app_name="marrow-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a sorted list of tuples."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
