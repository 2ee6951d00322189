"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from oracle import TABLES, database, rows_of

from cellwise.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, TABLES).toPandas()
    if name in ORACLES:
        wanted = db.sql(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
    else:
        assert len(found)
