import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from cueloom.session import build_session, release

    session = build_session("tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()
