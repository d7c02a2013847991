import pytest

from stratakit.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    columns, rows = rows_of(QUERIES[name](spark, SF))
    assert rows
    if name in ORACLE_SQL:
        assert rows == sql_rows(ORACLE_SQL[name], SF, columns)


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())
