from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from quillstream.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(rows, schema) -> DataFrame"""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
