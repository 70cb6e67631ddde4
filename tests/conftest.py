import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lineforge.session import get_spark

    shared = str(tmp_path_factory.mktemp("shared"))
    session = get_spark("tests", 4, **{"spark__sql__shuffle__partitions": "4", "spark__checkpoint__dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
