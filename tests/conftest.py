import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from mnemolake.session import local_session
    from mnemolake.shipping import ship

    session = local_session(int(os.environ.get("TEST_CPUS", "4")), 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
