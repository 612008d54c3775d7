from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from calendar_days import day  # noqa: E402

from askahead.schemas import EVENTS  # noqa: E402
from askahead.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Event table from (subject, day number or None, code) rows."""

    def make(rows):
        data = [(s, None if t is None else day(t), c) for s, t, c in rows]
        return spark.createDataFrame(data, EVENTS)

    return make
