import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tractus.session import get_session
    s = get_session("local[*]", 8, "tractus-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tractus-test-ckpt-"))
    yield s


GEOM = "array<array<array<struct<x:double,y:double>>>>"


def poly(*rings):
    """One polygon part from rings of (x, y) tuples (closed by the caller)."""
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]
