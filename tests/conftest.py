import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from logtriage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Make a log DataFrame of text lines: log(["a", "b"], block_lines=2)."""

    def make(lines, block_lines=2, file="log"):
        rows = [(file, n // block_lines, n, line) for n, line in enumerate(lines)]
        return spark.createDataFrame(rows, "file string, block bigint, pos bigint, line string")

    return make
