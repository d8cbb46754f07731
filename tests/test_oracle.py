"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(name, spark, con):
    assert check.compare(name, spark, con, SF) == ""


def test_only_fits_go_without_sql():
    # Corpus queries have tests of their own.
    own = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
    without = set(entry.queries()) - set(entry.oracle_sql()) - own
    assert without == {
        "ml_select_model",
        "ml_segment_models", "ml_forest_importance",
    }
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
