import pytest

from millrace.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_sql_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
