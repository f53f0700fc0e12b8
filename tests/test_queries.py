"""Every query against its SQL on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import connect, difference  # noqa: E402

from tessera.plans import oracle_sql, queries  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    said, _ = difference(spark, con, SF_DIR, queries()[name], oracle_sql()[name])
    assert not said


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    df = queries()[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
