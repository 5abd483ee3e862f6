"""Every query of the catalogue against its SQL, at the smallest scale."""

import pytest

from conftest import SMALL, canonical
from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
