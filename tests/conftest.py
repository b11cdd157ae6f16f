import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import CHUNK_ROWS_KEY, DEFAULT_CHUNK_ROWS, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, {"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(params=["whole", "chunked"])
def both_ways(request, spark):
    """Run a test with plain windows and again with every key cut into small chunks."""
    spark.conf.set(CHUNK_ROWS_KEY, "5" if request.param == "chunked" else str(DEFAULT_CHUNK_ROWS))
    yield request.param
    spark.conf.set(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS))
