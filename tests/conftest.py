import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillon.runtime import session, ship

    s = session("tests", "4", 4, **{"spark.driver.memory": "3g"})
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
