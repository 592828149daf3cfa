import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks import registry  # noqa: E402
from checks.compare import database, session  # noqa: E402

registry.load()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_CPUS", "4")
    return session()


@pytest.fixture(scope="session")
def databases():
    return {sf: database(sf) for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01")}
