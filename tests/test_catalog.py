"""Every registered query against its SQL, at two sizes."""

import pytest
from tests.conftest import SF, SF_MORE

from millrace.plans import catalog
from tests.oracle import connect, differences


@pytest.fixture(scope="module", params=[SF, SF_MORE])
def tables(request):
    return request.param, connect(request.param)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, tables, name):
    sf, con = tables
    assert differences(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name]) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
