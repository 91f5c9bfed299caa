import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from quirelight.session import build_session

    s = build_session("local[2]", "tests", spark__sql__shuffle__partitions="2", spark__driver__memory="3g")
    yield s
    s.stop()
