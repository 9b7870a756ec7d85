import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from cairn.session import get_session

    folder = tempfile.mkdtemp()
    s = get_session(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
