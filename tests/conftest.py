from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from cordwood.schema import ENVELOPE_SCHEMA, LOG_SCHEMA
from cordwood.session import build_session

NOW = datetime(2026, 7, 20, 15)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def logs(spark):
    """Logs from (id, time, …) tuples; what is left out gets a plain value."""

    def make(*rows):
        plain = ("info", "api", "hello", {})
        full = [tuple(row) + plain[len(row) - 2 :] for row in rows]
        return spark.createDataFrame(full, LOG_SCHEMA)

    return make


@pytest.fixture(scope="session")
def envelopes(spark):
    """Envelopes from bodies, received at NOW, with ids r0, r1, …"""

    def make(*bodies, received_at=NOW):
        rows = [(f"r{i}", body, received_at) for i, body in enumerate(bodies)]
        return spark.createDataFrame(rows, ENVELOPE_SCHEMA)

    return make
