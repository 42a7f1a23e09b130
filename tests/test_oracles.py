"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import oracle
import pytest

from quarrystone.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    said, _ = oracle.compare(spark, QUERIES[name], ORACLES[name])
    assert not said


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, oracle.SF_DIR)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
