import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)

from cohortis.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", os.environ.get("COHORTIS_TEST_CORES", "8"))
