from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from regionlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="regionlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """Evaluate a column expression over rows of one column `x`."""

    def run(rows, kind, expression):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")
        return [r[0] for r in frame.orderBy("i").select(expression).collect()]

    return run
