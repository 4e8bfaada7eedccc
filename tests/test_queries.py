"""Every registered query of the extraction operators against its DuckDB twin."""

import pytest

from tessera import oracle
from tessera import queries as own


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_equals_twin(spark, compare, data_dir, name):
    found, expected = compare(spark, f"{data_dir}/sf0.001", own.queries()[name], oracle.oracle_sql()[name])
    assert found == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
