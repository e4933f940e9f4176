"""Every query against its SQL twin on the smallest tables."""

import pytest

from flowkit.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, spark_rows):
    names, rows = spark_rows(catalog.QUERIES[name](spark, SF))
    assert names
    if name in catalog.ORACLE:
        expected, wanted = duck(SF, catalog.ORACLE[name])
        assert names == expected
        assert len(rows) == len(wanted)
        assert rows == wanted
