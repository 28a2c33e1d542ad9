import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from assaylake.session import local_session

    return local_session(8, "tests")


@pytest.fixture(scope="session")
def minutes():
    """Timestamps ``m`` minutes after a fixed start."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return lambda m: start + timedelta(minutes=m)
