import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quirefold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("quirefold-tests", cores=8, partitions=4)
    s.sparkContext.setLogLevel("FATAL")
    yield s
    s.stop()
