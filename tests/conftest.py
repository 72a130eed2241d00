import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from nucleoflow import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        master="local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
