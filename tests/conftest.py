import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools"), str(ROOT / "tests")]

from haloflux.session import configure, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(local_session(8, "haloflux-tests", "4g"))
    yield session
    session.stop()
