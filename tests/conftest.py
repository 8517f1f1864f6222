from __future__ import annotations

import pytest

from sievework.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
