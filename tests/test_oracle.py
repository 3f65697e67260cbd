"""Every registered query on the smallest data set, against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog import ORACLE, QUERIES
from oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours)
    assert difference(ours, con.execute(ORACLE[name]).df()) is None


def test_entry(spark):
    packed = entry(spark)
    assert packed.columns == ["sample_id", "s_id", "emb", "location", "lat", "lon", "year", "month", "hour", "day"]
    assert dict(packed.dtypes)["emb"] == "array<float>"
    assert packed.count() == 500
