"""Every registered query gives the rows of its SQL; the others run and return rows."""

import pytest

from packetloom.catalog import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import compare, connect

MODEL_QUERIES = {"score_two_stage", "detection_alerts", "feature_importance", "stream_score", "vector_classifier"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - MODEL_QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
