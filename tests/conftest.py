import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from threadlens.session import build_session, ensure_checkpoint_dir
    s = build_session("local[8]", 8)
    ensure_checkpoint_dir(s)
    yield s
