import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    from stemma.session import local_session

    return local_session("4", 4, "4g")
