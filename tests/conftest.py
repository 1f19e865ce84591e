from __future__ import annotations

from datetime import datetime

import pytest

from changeflow import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        4,
        **{"spark.sql.maxMetadataStringLength": "2000", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
