import pytest
from compare import assert_same

from edgeloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.SQL:
        assert_same(spark, FOLDER, catalog.QUERIES[name], catalog.SQL[name])
    else:
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
