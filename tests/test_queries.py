"""Every registered query of the library's own operators against its SQL."""

import pytest
from caregrid import catalog
from compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert_same(spark, catalog.queries()[name], sql, SF)
    else:
        assert catalog.queries()[name](spark, SF).count() > 0, "no rows"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
