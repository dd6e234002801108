"""Every registered query of the library itself against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from bidlattice.plans import catalogue
from oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        assert differences(df, catalogue.ORACLE_SQL[name], SF) == ""
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_security_filter_reaches_the_scan(spark):
    """The visibility filter stands below ranking and is pushed to Parquet."""
    plan = catalogue.QUERIES["c4_row_level_security"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(lang" in plan.replace("IsNotNull(lang), ", "")
