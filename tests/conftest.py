import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session

    session = build_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/tables"


def rows(df):
    """Rows as tuples, nulls first, in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in r])
