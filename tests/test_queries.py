"""Every registered query of the library against its SQL statement, or for rows where it has none."""

import pytest

from tests.conftest import SMALL
from veristrata import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(name, spark):
    rows = catalog.QUERIES[name](spark, SMALL).collect()
    assert rows and len(set(rows[0].asDict())) == len(rows[0])
