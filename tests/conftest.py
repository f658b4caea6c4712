from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sensorlith.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def cut_series(spark):
    """Make every ordered operator cut its series, as for keys too large for one task."""
    from sensorlith.operators.series import MAX_ROWS_CONF

    spark.conf.set(MAX_ROWS_CONF, "60")
    yield 60
    spark.conf.unset(MAX_ROWS_CONF)
