import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from trialstats.session import local_session  # noqa: E402

TESTDATA = Path(os.environ.get("TRIALSTATS_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = TESTDATA / "sf0.01"
    if not path.exists():
        pytest.skip("no test tables")
    return str(path)
