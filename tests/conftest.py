from __future__ import annotations

import pytest

from auditframe.plans.registry import RUNTIME
from auditframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    for key, value in RUNTIME.items():
        session.conf.set(key, value)
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """make(ddl, row, row, ...) -> DataFrame"""
    return lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
