import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import session

    return session("tests", int(os.environ.get("TEST_CPUS", "8")))
