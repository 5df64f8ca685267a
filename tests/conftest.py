import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tesserae.session import local_session

    s = local_session(8, "6g", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
