import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from termweave.session import local_session, share_code

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    share_code(s)
    return s
