"""Every registered query of the engine against its SQL, and a shape check of those without SQL."""

import pytest
from comparing import same

from orrery.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(found) or name == "quality_threshold"
        return
    assert same(found, duck.sql(SQL[name]).df()), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
