"""Every query against its SQL on the smallest tables; those without SQL give rows with a stable schema."""

import pytest

from chronoloom.queries import everything

from .conftest import SMALL
from .twins import check

QUERIES, SQL = everything()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, spark, duck):
    check(QUERIES[name], SQL[name], spark, duck, SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())
